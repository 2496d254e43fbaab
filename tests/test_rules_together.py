"""Values that must hold together: only the rarest is looked for, the others are read in the text."""
from faultlens.operators import matching, rules


def test_only_the_rarest_member_of_a_group_is_looked_for(spark):
    fields = spark.createDataFrame([(i, "text", "common words here" + (" seldom" if i % 10 == 0 else ""), None) for i in range(50)], "row long, field string, hay string, toks array<string>")
    together = spark.createDataFrame([("g", "text", "literal", v) for v in ("common", "words", "seldom")], "group string, field string, kind string, value string")
    held, proposed = matching.matches_and_groups(fields, together.drop("group").limit(0), together)
    assert held.count() == 0 and sorted(r.row for r in proposed.collect()) == [0, 10, 20, 30, 40]
    assert {frozenset(r.others) for r in proposed.collect()} == {frozenset(("common", "words"))}


def test_all_text_needs_all_of_its_values(spark):
    none = "array<string>"
    names = ["packages", "classes", "methods", "symbols", "libraries", "errors"]
    ctx = spark.createDataFrame([("a", "the left pad here"), ("b", "left only"), ("c", None), ("d", "pad the left")], "ctx_id string, text string").selectExpr(
        "ctx_id", "'r' AS repo", "text", *[f"CAST(array() AS {none}) AS {n}" for n in names])
    rows = [("two", "left"), ("two", "PAD"), ("three", "the"), ("three", "left"), ("three", "absent"), ("null", "left"), ("null", None), ("phrase", "left pad"), ("phrase", "e")]
    made = spark.createDataFrame([(i, "all_text", v) for i, v in rows] + [("any", "any_text", "only")], "rule_id string, key string, value string")
    assert sorted(map(tuple, rules.fired(ctx, made).collect())) == [("a", "phrase"), ("a", "two"), ("b", "any"), ("d", "two")]
