"""Registered queries: rule firing and selection, grounding, minting, lint, lifecycle and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.operators import lexical, rules
from faultlens.plans import tables as D
from faultlens.plans.vector_queries import rounded
from faultlens.session import spread

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def rule_rows(spark, d):
    """Rules of every benchmark item: long words, all short words, a pattern, and token clauses."""
    b = D.load(spark, d, "benchmark")
    item = F.col("item_id")
    words = F.array_distinct(T.matches(F.lower("text"), "[a-z]+"))
    longs = F.filter(words, lambda w: F.length(w) >= 10)
    fours = F.filter(words, lambda w: F.length(w) == 4)
    pattern = F.concat(F.lit("^"), F.regexp_extract(F.lower("text"), "([a-z]{2,})", 1), F.lit(" [a-z]+"))
    rows = F.concat(
        F.transform(longs, lambda w: F.struct(F.lit("any_text").alias("key"), w.alias("value"))),
        F.transform(fours, lambda w: F.struct(F.lit("all_text").alias("key"), w.alias("value"))),
        F.array(F.struct(F.lit("any_text_regex").alias("key"), pattern.alias("value")),
                F.struct(F.lit("any_classes").alias("key"), D.cat("=doc", item, "=7").alias("value")),
                F.struct(F.lit("any_errors_regex").alias("key"), D.cat("=^", F.when(item % 9 == 0, "d[ea]").otherwise("zz")).alias("value")),
                F.struct(F.lit("repo_in").alias("key"), D.cat("=src", F.when(item % 11 == 0, item % 20).otherwise(99)).alias("value"))))
    return b.select(item.alias("rule_id"), F.explode(rows).alias("r")).select("rule_id", "r.key", "r.value")


def doc_contexts(spark, d):
    none = F.array().cast("array<string>")
    return spread(D.load(spark, d, "documents")).select(
        F.col("doc_id").alias("ctx_id"), F.col("source").alias("repo"), F.lower("text").alias("text"), none.alias("packages"),
        F.array(D.cat("=Doc", "doc_id")).alias("classes"), none.alias("methods"), none.alias("symbols"), none.alias("libraries"),
        F.array("lang").alias("errors"))


FIRE_SQL = """w AS (SELECT item_id AS rule_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word, text FROM benchmark),
docs AS (SELECT doc_id AS ctx_id, source, lang, lower(text) AS t FROM documents),
b AS (SELECT item_id AS rule_id, '^' || regexp_extract(lower(text), '([a-z]{2,})', 1) || ' [a-z]+' AS pat FROM benchmark),
fours AS (SELECT rule_id, list(word) AS need FROM w WHERE length(word) = 4 GROUP BY 1),
fire AS (SELECT DISTINCT ctx_id, rule_id FROM docs, w WHERE length(word) >= 10 AND contains(t, word)
  UNION SELECT ctx_id, rule_id FROM docs, fours WHERE len(list_filter(need, lambda x: NOT contains(t, x))) = 0
  UNION SELECT ctx_id, rule_id FROM docs, b WHERE regexp_matches(t, pat)
  UNION SELECT ctx_id, item_id FROM docs, benchmark WHERE contains('doc' || ctx_id, 'doc' || item_id || '7')
  UNION SELECT ctx_id, item_id FROM docs, benchmark WHERE item_id % 9 = 0 AND regexp_matches(lang, '^d[ea]')
  UNION SELECT ctx_id, item_id FROM docs, benchmark WHERE item_id % 11 = 0 AND source = 'src' || (item_id % 20))"""


def hits(spark, d):
    return rules.fired(doc_contexts(spark, d), rule_rows(spark, d))


@query("fired_rules", f"WITH {FIRE_SQL} SELECT ctx_id, rule_id FROM fire")
def fired_rules(spark, d):
    return hits(spark, d)


TIER_SQL = "['candidate', 'applied', 'validated', 'canonical', 'retired'][1 + item_id % 5]"


def rule_meta(spark, d):
    item = F.col("item_id")
    tier = F.get(F.array(*[F.lit(t) for t in [*V.TIERS, "retired"]]), (item % 5).cast("int"))
    return D.load(spark, d, "benchmark").select(item.alias("rule_id"), (-item).alias("pos"), tier.alias("tier"))


@query("selected_rules", f"""WITH {FIRE_SQL}, s AS (SELECT ctx_id, rule_id, row_number() OVER (PARTITION BY ctx_id ORDER BY -rule_id) AS rank
  FROM fire JOIN benchmark ON item_id = rule_id WHERE {TIER_SQL} IN ('applied', 'validated', 'canonical')) SELECT ctx_id, rule_id, rank FROM s WHERE rank <= 2""")
def selected_rules(spark, d):
    return rules.select_rules(hits(spark, d), rule_meta(spark, d), "applied").select(
        "ctx_id", "rule_id", F.col("rank").cast("long").alias("rank"))


@query("selected_rules_by_vector", f"""WITH {FIRE_SQL}, s AS (SELECT ctx_id, rule_id, row_number() OVER (PARTITION BY ctx_id ORDER BY
   round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) DESC, rule_id) AS rank
  FROM fire JOIN benchmark ON item_id = rule_id JOIN embeddings q ON q.vec_id = ctx_id JOIN embeddings r ON r.vec_id = rule_id WHERE {TIER_SQL} <> 'retired')
SELECT ctx_id, rule_id, rank FROM s WHERE rank <= 3""")
def selected_rules_by_vector(spark, d):
    vecs = D.load(spark, d, "embeddings").select(F.col("vec_id").alias("ctx_id"), F.col("embedding").cast("array<double>").alias("vec"))
    # the query asks only for contexts and rules with a vector, as its SQL does; the operator takes any
    meta = rule_meta(spark, d).join(vecs.withColumnRenamed("ctx_id", "rule_id"), "rule_id")
    asked = hits(spark, d).join(vecs, "ctx_id", "left_semi")
    return rules.select_rules(asked, meta, "candidate", 3, vecs).select(
        "ctx_id", "rule_id", F.col("rank").cast("long").alias("rank"))


REF_SQL = f"""{D.UNITS_SQL}, refs AS (SELECT DISTINCT CASE WHEN conv_id % 3 = 0 THEN 'Doc' || conv_id WHEN conv_id % 3 = 1 THEN 'src' || (conv_id % 20) || '.en.Doc' || conv_id
   ELSE 'doc_missing' || conv_id END AS ref FROM conversations),
qterms AS (SELECT ref AS qid, unnest({D.sql_query_terms('ref')}) AS term FROM refs), {D.sql_bm25()},
top20 AS (SELECT * FROM (SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY score, uid) AS rn FROM scored) WHERE rn <= 20),
rs AS (SELECT ref, coalesce((SELECT bool_or(regexp_matches(concat_ws(' ', name, qualified_name, text), '(?i)(^|[^A-Za-z0-9_])' || replace(ref, '.', '\\.') || '($|[^A-Za-z0-9_])'))
   FROM top20 JOIN units USING (uid) WHERE qid = ref), false) AS resolved FROM refs)"""


def refs(spark, d):
    k = F.col("conv_id")
    ref = F.when(k % 3 == 0, D.cat("=Doc", k)).when(k % 3 == 1, D.cat("=src", k % 20, "=.en.Doc", k)).otherwise(D.cat("=doc_missing", k))
    return D.load(spark, d, "conversations").select(ref.alias("ref")).distinct()


@query("resolved_refs", f"WITH {REF_SQL} SELECT ref, resolved FROM rs")
def resolved_refs(spark, d):
    return rules.resolve_refs(D.units(spark, d), refs(spark, d))


def skills(spark, d):
    """Raw rule texts of conversation turns, some clauses left out."""
    c = D.load(spark, d, "conversations")
    k, turn = F.col("conv_id"), F.col("turn")
    guidance = F.concat_ws("\n", F.when(turn != 1, D.cat("=Signature: crash ", k)), F.when(turn != 2, D.cat("=  Localize: file", k, "=.java")),
                           F.lit("note"), D.cat("=Fix: call ", "role"))
    ref = F.when(k % 3 == 0, D.cat("=Doc", k)).when(k % 3 == 1, D.cat("=src", k % 20, "=.en.Doc", k)).otherwise(D.cat("=doc_missing", k))
    match = F.when(turn == 3, F.create_map().cast("map<string,array<string>>")).when(
        turn == 4, F.create_map(F.lit("odd_key"), F.array(F.lit("x")))).otherwise(F.create_map(F.lit("any_text"), F.array(D.cat("=word", k), F.lit("owner1"))))
    return c.select(D.cat("=s", k, "=-", turn).alias("id"), guidance.alias("guidance"), F.array(ref, F.lit(" ")).alias("hint_apis"), match.alias("applies_when"),
                    F.array("role").alias("signals"), F.when(turn != 5, F.lit("doc")).otherwise("").alias("provenance"))


def denylist(spark, d):
    """Lower-cased owner tokens: customer-nation names used as owners."""
    n = D.load(spark, d, "nation")
    owners = n.select(D.cat("=Owner", "n_nationkey").alias("repo"), F.array(D.cat("=net.owner", "n_nationkey")).alias("namespaces"),
                      F.array("n_name").alias("slugs"), F.array(D.cat("=libowner", "n_nationkey", "=.so")).alias("sonames"))
    return owners, rules.owner_denylist(owners)


@query("owner_denylist", """SELECT lower(unnest(['Owner' || n_nationkey, 'net.owner' || n_nationkey, n_name, 'libowner' || n_nationkey || '.so'])) AS token FROM nation""")
def owner_denylist(spark, d):
    return denylist(spark, d)[1]


@query("missing_owner_rows", """SELECT DISTINCT 'Owner' || (c_custkey % 40) AS repo FROM customer WHERE c_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)""")
def missing_owner_rows(spark, d):
    fleet = D.load(spark, d, "customer").select(D.cat("=Owner", F.col("c_custkey") % 40).alias("repo"))
    return rules.missing_owners(fleet, denylist(spark, d)[0])


GROUND_SQL = f"""{REF_SQL}, c AS (SELECT 's' || conv_id || '-' || turn AS id, turn, role, conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Doc' || conv_id
   WHEN conv_id % 3 = 1 THEN 'src' || (conv_id % 20) || '.en.Doc' || conv_id ELSE 'doc_missing' || conv_id END AS ref FROM conversations),
g AS (SELECT c.*, resolved, concat_ws(',', CASE WHEN turn = 1 THEN 'empty_signature' END, CASE WHEN turn = 3 THEN 'empty_predicate' END,
   CASE WHEN turn = 4 THEN 'bad_predicate:odd_key' END, CASE WHEN NOT resolved THEN 'unresolved_refs:' || c.ref END,
   CASE WHEN turn NOT IN (3, 4) THEN 'leak:owner1' END) AS reasons FROM c JOIN rs ON rs.ref = c.ref)"""


def checks(spark, d):
    items = rules.seed_items(skills(spark, d))
    resolved = rules.resolve_refs(D.units(spark, d), refs(spark, d))
    return items, rules.check_grounded(items, resolved, denylist(spark, d)[1])


@query("grounding_checks", f"WITH {GROUND_SQL} SELECT id, reasons = '' AS grounded, reasons FROM g")
def grounding_checks(spark, d):
    return checks(spark, d)[1].select("id", "grounded", F.array_join("reasons", ",").alias("reasons"))


@query("seeded_store", f"""WITH {GROUND_SQL}
SELECT id, CASE WHEN turn = 1 THEN '' ELSE 'crash ' || conv_id END AS signature, CASE WHEN turn = 2 THEN '' ELSE 'file' || conv_id || '.java' END AS localize,
  'call ' || role AS fix, ref AS required_apis, tier FROM (SELECT *, 'candidate' AS tier FROM g WHERE reasons = '' AND conv_id % 4 <> 0
  UNION ALL SELECT *, 'canonical' FROM g WHERE conv_id % 4 = 0)""")
def seeded_store(spark, d):
    # every turn of a fourth of the conversations is in the store already
    items, found = checks(spark, d)
    old = items.where(F.regexp_extract("id", r"s(\d+)-", 1).cast("int") % 4 == 0).withColumn("tier", F.lit("canonical"))
    merged = rules.merge_items(items, found, old)
    return merged.select("id", "signature", F.array_join("localize", ",").alias("localize"), F.array_join("fix", ",").alias("fix"),
                         F.array_join("required_apis", ",").alias("required_apis"), "tier")


@query("corpus_issues", """WITH c AS (SELECT 's' || conv_id || '-' || turn AS id, turn FROM conversations)
SELECT id, 'missing provenance' AS issue FROM c WHERE turn = 5 UNION ALL SELECT id, 'guidance missing ''Signature:'' clause' FROM c WHERE turn = 1
UNION ALL SELECT id, 'guidance missing ''Localize:'' clause' FROM c WHERE turn = 2 UNION ALL SELECT id, 'empty match (would never fire)' FROM c WHERE turn = 3
UNION ALL SELECT id, 'unknown match key ''odd_key''' FROM c WHERE turn = 4 UNION ALL SELECT id, 'LEAK: owner token ''owner1'' present' FROM c WHERE turn NOT IN (3, 4)""")
def corpus_issues(spark, d):
    return rules.lint(skills(spark, d).withColumnRenamed("applies_when", "match"), denylist(spark, d)[1])


@query("minted_items", """WITH f AS (SELECT o_orderkey AS case_id, ['Panel' || (o_custkey % 50) || '.open', 'draw'] AS methods, ['E' || (o_orderkey % 7)] AS errors FROM orders),
m AS (SELECT 'minted-' || substr(sha1(array_to_string(list_sort(list_distinct(list_concat(errors, methods))), '|')), 1, 10) AS id, array_to_string(list_concat(errors, methods), ' ') AS signature,
   methods[1] || ',draw' AS refs, 'minted:' || case_id AS provenance FROM f)
SELECT id, min(signature) AS signature, min(refs) AS refs, min(provenance) AS provenance FROM m GROUP BY 1""")
def minted_items(spark, d):
    none = F.array().cast("array<string>")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    panel = D.cat("=Panel", c % 50, "=.open")
    sig = F.struct(none.alias("packages"), none.alias("classes"), F.array(panel, F.lit("draw")).alias("methods"), none.alias("symbols"), none.alias("libraries"),
                   F.array(D.cat("=E", k % 7)).alias("errors"))
    diff = D.cat("=+++ b/x\n+  ", panel, "=(view.draw, other);\n-  gone")
    fixes = D.load(spark, d, "orders").select(k.alias("case_id"), sig.alias("signals"), none.alias("locations"), diff.alias("patch_diff"))
    return rules.first_minted(rules.mint_items(fixes)).select("id", "signature", F.array_join("refs", ",").alias("refs"), "provenance")


@query("grounded_minted_items", f"""WITH {REF_SQL}, f AS (SELECT 10 * conv_id + turn AS case_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Doc' || conv_id
   WHEN conv_id % 3 = 1 THEN 'src' || (conv_id % 20) || '.en.Doc' || conv_id ELSE 'doc_missing' || conv_id END AS ref FROM conversations)
SELECT 'minted-' || substr(sha1(f.ref), 1, 10) AS id, f.ref AS signature, f.ref AS refs, min('minted:' || case_id) AS provenance
FROM f JOIN rs ON rs.ref = f.ref WHERE resolved AND turn NOT IN (2, 3) GROUP BY 2""")
def grounded_minted_items(spark, d):
    # the second turn's patch touches nothing that its signals name, the third's error names an owner
    none = F.array().cast("array<string>")
    k, turn = F.col("conv_id"), F.col("turn")
    ref = F.when(k % 3 == 0, D.cat("=Doc", k)).when(k % 3 == 1, D.cat("=src", k % 20, "=.en.Doc", k)).otherwise(D.cat("=doc_missing", k))
    sig = F.struct(none.alias("packages"), none.alias("classes"), F.array(ref).alias("methods"), none.alias("symbols"), none.alias("libraries"),
                   F.when(turn == 3, F.array(F.lit("Owner1"))).otherwise(none).alias("errors"))
    diff = F.when(turn == 2, F.lit("+++ b/x\n+  other();")).otherwise(D.cat("=+++ b/x\n+  ", ref, "=(other);\n-  gone"))
    fixes = D.load(spark, d, "conversations").select((10 * k + turn).alias("case_id"), sig.alias("signals"), none.alias("locations"), diff.alias("patch_diff"))
    return rules.mint_grounded(fixes, D.units(spark, d), denylist(spark, d)[1]).select("id", "signature", F.array_join("refs", ",").alias("refs"), "provenance")


@query("placebo_items", f"""WITH c AS (SELECT 's' || conv_id || '-' || turn AS id, CASE WHEN turn = 1 THEN '' ELSE 'crash ' || conv_id END AS sig, turn, 'call ' || role AS fix FROM conversations)
SELECT 'placebo-' || id AS id, substr(repeat('{V.PLACEBO_FILLER}', 3), 1, greatest(length(sig), 40)) AS signature, CASE WHEN turn = 2 THEN 0 ELSE 40 END AS localize_length,
  substr('{V.PLACEBO_FILLER}', 1, greatest(length(fix), 40)) AS fix FROM c""")
def placebo_items(spark, d):
    return rules.placebos(rules.seed_items(skills(spark, d))).select(
        "id", "signature", F.length(F.array_join("localize", "")).alias("localize_length"), F.array_join("fix", "").alias("fix"))


# --- lifecycle ---------------------------------------------------------------------------------------

FOLD_SQL = """v AS (SELECT user_id AS item, event_id AS seq, value > 20 AS passed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
st(item, i, tier, streak, n_dem) AS (SELECT DISTINCT item, 0::BIGINT, 0, 0, 0 FROM v UNION ALL
  SELECT s.item, v.i, CASE WHEN s.tier < 0 THEN s.tier WHEN v.passed THEN least(s.tier + 1, 3) WHEN s.streak + 1 >= 2 THEN {floor} ELSE s.tier END,
    CASE WHEN s.tier < 0 THEN s.streak WHEN v.passed OR s.streak + 1 >= 2 THEN 0 ELSE s.streak + 1 END,
    s.n_dem + CASE WHEN s.tier >= 0 AND NOT v.passed AND s.streak + 1 >= 2 THEN 1 ELSE 0 END
  FROM st s JOIN v ON v.item = s.item AND v.i = s.i + 1),
last AS (SELECT item, arg_max(tier, i) AS tier, arg_max(streak, i) AS streak, arg_max(n_dem, i) AS n_dem FROM st GROUP BY 1)"""


def verdicts(spark, d):
    return D.load(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("passed"))


@query("folded_tiers", f"""WITH RECURSIVE {FOLD_SQL.replace('{floor}', 'greatest(s.tier - 1, 0)')}
SELECT item, ['candidate', 'applied', 'validated', 'canonical'][1 + tier] AS tier, streak AS fail_count, CAST(n_dem AS INTEGER) AS n_demotions FROM last""")
def folded_tiers(spark, d):
    return rules.fold_verdicts(verdicts(spark, d)).select("item", "tier", "fail_count", F.size("demotions").alias("n_demotions"))


@query("folded_tiers_retiring", f"""WITH RECURSIVE {FOLD_SQL.replace('{floor}', 's.tier - 1')}
SELECT item, CASE WHEN tier < 0 THEN 'retired' ELSE ['candidate', 'applied', 'validated', 'canonical'][1 + tier] END AS tier, streak AS fail_count,
  CAST(n_dem AS INTEGER) AS n_demotions FROM last""")
def folded_tiers_retiring(spark, d):
    return rules.fold_verdicts(verdicts(spark, d), retire=True, chunk=1000).select("item", "tier", "fail_count", F.size("demotions").alias("n_demotions"))


def store_rows(spark, d):
    c = F.col("c_custkey")
    tier = F.get(F.array(*[F.lit(t) for t in [*V.TIERS, "retired"]]), (c % 5).cast("int"))
    return D.load(spark, d, "customer").select(c.alias("id"), tier.alias("tier"), (c % 2).cast("int").alias("fail_count"), F.array(F.lit("old")).alias("demotions"),
                                               (F.col("c_acctbal") > 4000).alias("passed"))


@query("promoted_items", """WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 5 AS INTEGER) AS t, CAST(c_custkey % 2 AS INTEGER) AS f, c_acctbal > 4000 AS ok FROM customer),
n AS (SELECT *, ['candidate', 'applied', 'validated', 'canonical', 'retired'] AS names, CASE WHEN t = 4 THEN 4 WHEN ok THEN least(t + 1, 3) WHEN f + 1 >= 2 THEN CASE WHEN t = 0 THEN 4 ELSE t - 1 END ELSE t END AS nt FROM c)
SELECT id, names[1 + nt] AS tier, CASE WHEN t = 4 THEN f WHEN ok OR f + 1 >= 2 THEN 0 ELSE f + 1 END AS fail_count,
  'old' || CASE WHEN t < 4 AND NOT ok AND f + 1 >= 2 THEN ',' || names[1 + t] || '->' || names[1 + nt] ELSE '' END AS demotions FROM n""")
def promoted_items(spark, d):
    return rules.promote_or_retire(store_rows(spark, d)).select("id", "tier", "fail_count", F.array_join("demotions", ",").alias("demotions"))


LIFT_SQL = """a AS (SELECT o_orderkey AS case_id, ['K' || (o_custkey % 30), 'K' || (o_orderkey % 30)] AS fired, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS g,
  o_totalprice > 150000 AS ap FROM orders),
s AS (SELECT *, 0.5 * g + CASE WHEN ap THEN 0.5 ELSE 0 END AS sig FROM a WHERE g IS NOT NULL),
it AS (SELECT DISTINCT 'K' || (c_custkey % 40) AS id FROM customer WHERE c_custkey % 40 % 5 <> 4),
l AS (SELECT id, avg(sig) FILTER (WHERE list_contains(fired, id)) - avg(sig) FILTER (WHERE NOT list_contains(fired, id)) AS lift FROM it, s GROUP BY 1)"""


def fired_archive(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return D.load(spark, d, "orders").select(
        k.alias("case_id"), F.array(D.cat("=K", c % 30), D.cat("=K", k % 30)).alias("fired"),
        F.when(k % 9 != 0, (k % 10) / 10.0).cast("double").alias("groundedness"), (F.col("o_totalprice") > 150000).alias("patch_applies"))


def fired_items(spark, d):
    x = F.col("c_custkey") % 40
    tier = F.get(F.array(*[F.lit(t) for t in [*V.TIERS, "retired"]]), (x % 5).cast("int"))
    return D.load(spark, d, "customer").select(D.cat("=K", x).alias("id"), tier.alias("tier"), (x % 2).cast("int").alias("fail_count"),
                                               F.array().cast("array<string>").alias("demotions"), (x % 3 == 0).alias("passed")).distinct()


@query("screen_lift", f"WITH {LIFT_SQL} SELECT id, round(lift, 6) AS lift FROM l WHERE lift IS NOT NULL AND abs(lift) >= 0.002")
def screen_lift(spark, d):
    return rounded(rules.screen_lift(fired_archive(spark, d), fired_items(spark, d), 0.002))


@query("promotion_evidence", f"""WITH {LIFT_SQL},
e AS (SELECT id, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE ap))::DOUBLE / count(*) AS p FROM it JOIN s ON list_contains(fired, id) GROUP BY 1),
w AS (SELECT id, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM e),
i AS (SELECT id, greatest(0, mid - half) AS low, least(1, mid + half) AS high FROM w),
c AS (SELECT DISTINCT c_custkey % 40 AS x FROM customer),
g AS (SELECT 'K' || x AS id, CAST(x % 5 AS INTEGER) AS t, CAST(x % 2 AS INTEGER) AS f, x % 3 = 0 AS ok, ['candidate', 'applied', 'validated', 'canonical', 'retired'] AS names FROM c)
SELECT id, names[1 + CASE WHEN t = 4 THEN 4 WHEN ok THEN least(t + 1, 3) WHEN f + 1 >= 2 THEN CASE WHEN t = 0 THEN 4 ELSE t - 1 END ELSE t END] AS tier,
  round(lift, 6) AS measured_lift, round(low, 6) AS low, round(high, 6) AS high
FROM g LEFT JOIN l USING (id) LEFT JOIN i USING (id)""")
def promotion_evidence(spark, d):
    items = fired_items(spark, d)
    out = rules.promote_or_retire(items, evidence=rules.lift_evidence(fired_archive(spark, d), items))
    return out.select("id", "tier", F.round("measured_lift", 6).alias("measured_lift"), F.round("wilson95.low", 6).alias("low"), F.round("wilson95.high", 6).alias("high"))


@query("validating_cases", """WITH a AS (SELECT o_orderkey AS case_id, unnest(list_distinct(['K' || (o_custkey % 30), 'K' || (o_orderkey % 30)])) AS id FROM orders
  WHERE o_orderkey % 9 <> 0 AND o_totalprice > 150000)
SELECT id, case_id FROM a WHERE id IN (SELECT 'K' || (c_custkey % 40) FROM customer WHERE c_custkey % 40 % 5 <> 4)""")
def validating_cases(spark, d):
    return rules.validating_cases(fired_archive(spark, d), fired_items(spark, d))


def scored_sets(spark, d):
    """Scores of the full nation set and of every set without one nation, from order totals."""
    o = D.load(spark, d, "orders")
    total = o.groupBy((F.col("o_custkey") % 25).alias("k")).agg(F.sum("o_totalprice").alias("s"))
    every = total.agg(F.array_sort(F.collect_list(D.cat("=K", "k"))).alias("ids"), F.sum("s").alias("score"))
    minus = total.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one").select(
        F.array_except("ids", F.array(D.cat("=K", "k"))).alias("ids"), (F.col("score") - F.col("s") + F.when(F.col("k") % 3 == 0, 2 * F.col("s")).otherwise(0)).alias("score"))
    return every.unionByName(minus)


DELTA_SQL = """t AS (SELECT o_custkey % 25 AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1),
dl AS (SELECT 'K' || k AS id, CASE WHEN k % 3 = 0 THEN -s ELSE s END AS delta FROM t)"""


@query("leave_one_out_deltas", f"WITH {DELTA_SQL} SELECT id, round(delta, 2) AS delta FROM dl")
def leave_one_out_deltas(spark, d):
    return rules.leave_one_out(scored_sets(spark, d)).select("id", F.round("delta", 2).alias("delta"))


@query("governed_items", f"""WITH {DELTA_SQL}, it AS (SELECT 'K' || n_nationkey AS id, CAST(n_nationkey % 5 AS INTEGER) AS t, n_nationkey FROM nation),
j AS (SELECT it.*, n_nationkey % 2 = 0 AND delta > 0 AS ok, ['candidate', 'applied', 'validated', 'canonical', 'retired'] AS names FROM it JOIN dl USING (id))
SELECT id, names[1 + CASE WHEN t = 4 THEN 4 WHEN ok THEN least(t + 1, 3) WHEN t = 0 THEN 4 ELSE t - 1 END] AS tier FROM j""")
def governed_items(spark, d):
    n = F.col("n_nationkey")
    tier = F.get(F.array(*[F.lit(t) for t in [*V.TIERS, "retired"]]), n % 5)
    nation = D.load(spark, d, "nation")
    items = nation.select(D.cat("=K", n).alias("id"), tier.alias("tier"), F.lit(1).alias("fail_count"), F.array().cast("array<string>").alias("demotions"))
    verdict = nation.select(D.cat("=K", n).alias("id"), (n % 2 == 0).alias("accepted"))
    return rules.govern(items, rules.leave_one_out(scored_sets(spark, d)), verdict).select("id", "tier")


@query("rendered_items", f"""WITH {FIRE_SQL}, s AS (SELECT ctx_id, rule_id, row_number() OVER (PARTITION BY ctx_id ORDER BY -rule_id) AS rank FROM fire JOIN benchmark ON item_id = rule_id
   WHERE {TIER_SQL} <> 'retired'),
x AS (SELECT ctx_id, rank, '# Crash playbook: ' || rule_id || chr(10) || 'Signature: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'Look at: a; b' || chr(10) || 'Fix: ' || chr(10) || 'APIs: x' AS blk
   FROM s JOIN benchmark ON item_id = rule_id WHERE rank <= 2)
SELECT ctx_id, md5(chr(10) || chr(10) || '# Grounded playbooks' || chr(10) || string_agg(blk, chr(10) || chr(10) ORDER BY rank)) AS text_md5 FROM x GROUP BY 1""")
def rendered_items(spark, d):
    chosen = rules.select_rules(hits(spark, d), rule_meta(spark, d), "candidate")
    b = D.load(spark, d, "benchmark").select(F.col("item_id").alias("rule_id"), F.col("text").alias("signature"))
    rows = chosen.join(b, "rule_id").select("ctx_id", "rank", F.col("rule_id").alias("id"), "signature", F.array(F.lit("a"), F.lit("b")).alias("localize"),
                                            F.array().cast("array<string>").alias("fix"), F.array(F.lit("x")).alias("required_apis"))
    return rules.render_items(rows).select("ctx_id", F.md5("text").alias("text_md5"))


@query("rendered_skills", """SELECT conv_id AS ctx_id, md5(chr(10) || chr(10) || '# Applicable playbooks' || chr(10) || string_agg('## Skill: s' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text_md5
FROM conversations GROUP BY 1""")
def rendered_skills(spark, d):
    c = D.load(spark, d, "conversations").select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("rank"), D.cat("=s", "turn").alias("id"), F.col("text").alias("guidance"))
    return rules.render_skills(c).select("ctx_id", F.md5("text").alias("text_md5"))


@query("skill_queries", """SELECT 's' || conv_id || '-' || turn AS id, role || CASE WHEN turn <> 2 THEN ' file' || conv_id || '.java' ELSE '' END AS query FROM conversations""")
def skill_queries(spark, d):
    return skills(spark, d).select("id", rules.skill_query(F.col("signals"), F.col("guidance")).alias("query"))
