"""Selection by vector keeps contexts and rules without a vector."""
from faultlens.operators import rules


def test_rules_without_vectors_follow_in_store_order(spark):
    hits = spark.createDataFrame([(c, r) for c in (1, 2) for r in (10, 11, 12, 13)], "ctx_id long, rule_id long")
    meta = spark.createDataFrame([(10, 4, "applied", None), (11, 3, "applied", [0.0, 1.0]), (12, 2, "applied", [1.0, 0.0]), (13, 1, "applied", None)],
                                 "rule_id long, pos int, tier string, vec array<double>")
    vecs = spark.createDataFrame([(1, [1.0, 0.1])], "ctx_id long, vec array<double>")
    got = {}
    for r in rules.select_rules(hits, meta, "applied", 4, vecs).orderBy("ctx_id", "rank").collect():
        got.setdefault(r.ctx_id, []).append(r.rule_id)
    assert got == {1: [12, 11, 13, 10], 2: [13, 12, 11, 10]}
