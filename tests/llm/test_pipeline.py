import os

from llm_rows import prose, row

import corpus_pipeline
from tallyloom.operators.shared import scratch


def test_stages(spark, frame, tmp_path):
    rows = [row(i, prose(i, 90) + "\nSubscribe to our letter\n" + prose(600 + i, 40), "en", "ab"[i % 2]) for i in range(80)]
    rows += [row(100 + k, rows[0][1]) for k in range(5)] + [row(200, "too short"), row(201, None)]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(docs)
    columns = frame([]).columns
    assert all(d.columns == columns for d in seen[:-1])
    ids = [sorted(r.doc_id for r in d.collect()) for d in seen]
    assert ids[0] == [*range(80), *range(100, 105)]
    assert not seen[1].where("text like '%Subscribe%'").count() and ids[1] == ids[0]
    assert ids[2] == list(range(80))
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert sum(r.n_tokens for r in seen[4].collect()) > 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in seen[4].collect())


def test_only_the_last_input_stays(spark, frame, tmp_path):
    """Around the run, the one table left is the input of the stage that is handed out."""
    frame([row(i, prose(i, 90), "en", "ab"[i % 2]) for i in range(30)]).write.parquet(str(tmp_path / "documents.parquet"))
    with scratch(spark) as folder:
        whole = corpus_pipeline.run(spark, str(tmp_path))
        assert len([d for d in os.listdir(folder.removeprefix("file:")) if not d.startswith(".")]) == 1
        assert whole.count() > 0
    assert not os.path.exists(folder.removeprefix("file:"))


def test_null_and_repeated_ids_and_clashing_columns(spark, frame, tmp_path):
    rows = [row(None if i % 3 else 5, prose(i, 90) + "\nSubscribe to our letter\n" + prose(600 + i, 40), "en", "ab"[i % 2]) for i in range(60)]
    rows += [rows[0]] * 4
    docs = frame(rows)
    for c in ("n_words", "kept", "n_dropped", "document", "near_row", "mix_row", "copies"):
        docs = docs.withColumnRenamed("words", c) if c == "n_words" else docs.withColumn(c, docs["n_words"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns and out.where("n_words = 3 and kept = 3 and document = 3").count() == out.count()
        seen = out
        sizes.append(out.count())
    assert sizes == [64, 64, 60, 60]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == 60
