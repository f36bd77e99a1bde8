from tallyloom.operators import claims as C


def test_claims_are_parsed_once_and_not_shuffled(spark):
    """The text of the claims is read by one expression; entities that are there twice count once, those without an id not at all."""
    d = spark.createDataFrame([("a", '{"P31": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "Q1"}}}}], "P856": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": "http://a"}}}]}')] * 2 + [("b", "{broken"), (None, "{}")], "qid string, claims string")
    plan = C.facts(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson(") == 1, plan
    labels = spark.createDataFrame([("Q1", "school")], "id string, label string")
    out = C.enrich(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "qid string"), d, labels)
    assert "claims" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.qid, r.instance_of, r.website, r.dissolved) for r in out.collect()} == {("a", "school", "http://a", False), ("b", "", "", False), ("c", "", "", False), (None, "", "", False)}
