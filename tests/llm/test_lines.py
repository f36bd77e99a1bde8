import re
from collections import Counter, defaultdict
from hashlib import md5

from llm_rows import prose, row
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    hit = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_counts(frame, edge_rows):
    rows = edge_rows + [row(20, "a b c d a b c x\na b c\na b c\n\n a b c"), row(21, "w " * 120), row(22, "x y z x y z x y z q")]
    out = lines.quality_rules(frame(rows)).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted(base(r[1]) for r in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert lines.quality_rules(frame([])).count() == 0


def site(n, shared):
    return [row(i, f"{prose(i, 60)}\n{shared}\n{prose(1000 + i, 30)}") for i in range(n)]


def test_frame_lines_go_and_clean_text_stays(frame):
    rows = site(60, "Subscribe to our letter") + [row(100, "Subscribe to our letter"), row(101, prose(5000, 70), "en", "b")]
    rows += [row(200 + i, prose(7777, 70)) for i in range(40)]  # copies of one document aren't a frame
    out = {r.doc_id: r for r in lines.drop_site_lines(frame(rows), stats=True).collect()}
    assert all("Subscribe" not in out[i].text and out[i].n_dropped == 1 for i in range(60))
    assert out[100].text == "" and out[101].text == rows[61][1] and out[200].text == prose(7777, 70)


def test_depleted_documents_are_rejected(frame):
    frame_line = prose(9, 60)
    rows = site(60, frame_line) + [row(100, frame_line + "\nown words")]
    out = {r.doc_id: r for r in lines.quality_rules(frame(rows)).collect()}
    assert not out[100].base_failed and not out[100].kept and out[0].kept


def test_quality_rules_take_frequent_lines_away(spark, frame):
    rows = site(60, "Subscribe to our letter") + [row(100, prose(5000, 70), "en", "b"), row(101, None)]
    docs = frame(rows).withColumn("n_chars", F.lit(1).cast("long"))
    out = {r.doc_id: r for r in lines.quality_rules(docs).collect()}
    assert all(out[i].text == rows[i][1].replace("Subscribe to our letter\n", "") and out[i].n_words == 94 for i in range(60))
    assert out[100].text == rows[60][1] and out[101].text is None
    staged = corpus_pipeline.quality(spark, docs, "").collect()
    assert len(staged) == 61 and all(r.text == out[r.doc_id].text and r.n_chars == len(r.text) for r in staged)


def test_a_frame_line_counts_by_pages_if_it_is_the_smallest(frame):
    frame_line = min((prose(k, 6) for k in range(20_000)), key=lambda x: md5(x.encode()).hexdigest())
    rows = site(60, frame_line)
    out = lines.drop_site_lines(frame(rows), stats=True).collect()
    assert all(r.n_dropped == 1 and frame_line not in r.text for r in out)
    assert all(r.n_frequent_words == 6 for r in lines.quality_rules(frame(rows)).collect())
    two = site(200, frame_line + "\nAll rights reserved")
    assert sum(r.n_dropped for r in lines.drop_site_lines(frame(two), stats=True).collect()) == 400


def by_hand(rows, min_docs, max_ratio, max_docs):
    """(host, normalised line) above the limits, from the documents themselves."""
    holds, pages = defaultdict(set), defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if WORD.search(line):
                pages[r[3]].add(r[1])
                holds[r[3], line.strip(" \t\r\x0b\x0c").lower()].add(r[1])
    return {k for k, v in holds.items() if len(v) >= min_docs and (len(v) > max_ratio * len(pages[k[0]]) or len(v) > max_docs)}


def test_against_counts_by_hand(frame):
    shared = [prose(900 + k, 5) for k in range(6)]
    rows = [row(i, "\n".join([prose(i, 30), *(s if i % 2 else s.upper() + " " for k, s in enumerate(shared) if i % (3 * k + 1) == 0), prose(400 + i, 25)]), "en", "ab"[i % 5 == 0] if i % 11 else None) for i in range(300)]
    rows += rows[:30]
    for options in ({"min_docs": 10, "max_ratio": 0.2, "max_docs": 10**6}, {"min_docs": 10, "max_ratio": 0.9, "max_docs": 40}):
        gone = by_hand(rows, **options)
        assert gone
        out = lines.quality_rules(frame(rows), **options).collect()
        want = {r[0]: "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" ").lower()) not in gone) for r in rows}
        assert {r.doc_id: r.text for r in out} == want


def test_columns_named_as_the_results(frame):
    docs = frame(site(20, "Subscribe")).withColumns({c: F.lit("mine") for c in (*lines.COUNTS, "kept", "base_failed", "n_lines", "n_dropped", "frequent", "own_frequent")})
    out = lines.quality_rules(docs)
    assert len(set(out.columns)) == len(out.columns) and out.where("kept").count() == 20
    out = lines.drop_site_lines(docs, stats=True)
    assert out.agg(F.sum("n_dropped")).first()[0] == 20 and out.where("kept = 'mine'").count() == 20


def test_edges(frame, edge_rows):
    out = lines.drop_site_lines(frame(edge_rows)).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(r[1]) for r in edge_rows)
    assert lines.drop_site_lines(frame([])).count() == 0


def test_long_lists_of_frequent_lines_give_the_same(frame):
    rows = site(60, "\n".join(f"Frame line number {k} of this site" for k in range(8))) + [row(100 + i, prose(5000 + i, 70), "en", None) for i in range(30)]
    rows += [row(200 + i, prose(7000 + i, 60) + "\nshared with no host", "en", None) for i in range(30)] + [row(300, None), row(301, ""), row(None, rows[3][1])]
    rows += [rows[5]] * 3 + [row(400 + i, rows[7][1]) for i in range(20)]
    for f in (lambda n: lines.quality_rules(frame(rows), listed=n), lambda n: lines.drop_site_lines(frame(rows), stats=True, listed=n)):
        lists, exploded, mixed = (sorted(map(str, f(n).collect())) for n in (1000, 0, 5))
        assert lists == exploded == mixed
    out = {r.doc_id: r for r in lines.drop_site_lines(frame(rows), stats=True, listed=0).collect()}
    assert out[0].n_dropped == 8 and out[405].n_dropped == 8 and out[205].n_dropped == 1 and out[105].n_dropped == 0
