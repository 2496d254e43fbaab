"""Registered queries: fix and run grading, acceptance, plans, costs and context blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import diffs as X
from faultlens.operators import context, grading
from faultlens.plans import tables as D
from faultlens.plans.vector_queries import rounded, sql_wilson

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def K():  # noqa: N802
    return F.col("o_orderkey")


def C():  # noqa: N802
    return F.col("o_custkey")


def path(i, root: str = "app/src/main/java/"):
    return D.cat(f"={root}org/acme/m", C() % 97, "=/F", i, "=.java")


def plan_json(shift: int):
    body = D.cat('={"root_cause": "r", "targets": [{"file": "', path((K() + shift) % 3), '=", "symbol": "call', (K() + shift) % 3,
                 '="}], "required_apis": ["CALL', C() % 3, '="], "strategy": "s", "confidence": 0.5}')
    return F.when(K() % 6 != 0, D.cat("=ok\n```json\n", body, "=\n```"))


def fix_records(spark, d, shift: int = 0, arm: str = "base"):
    """One fix record per order; shift turns the located file and the called API."""
    o = D.load(spark, d, "orders")
    at = (K() + shift) % 3
    util = F.when(K() % 5 == 0, "+  // util later").otherwise("+  util();")
    diff = D.cat("=--- a/x\n+++ b/", path(at), "=\n@@\n+  call", at, "=();\n", util)
    return o.select(
        K().alias("case_id"), F.lit(arm).alias("arm"), F.array(path(at), path(C() % 3), path((K() + C()) % 3)).alias("locations"),
        diff.alias("patch_diff"), (F.col("o_orderstatus") != "P").alias("patch_emitted"), (F.col("o_totalprice") > 150000).alias("patch_applies"),
        (F.round(F.col("o_totalprice") / 1000) / 1000).alias("cost_usd"), X.parse_plan(plan_json(shift)).alias("plan"),
        F.when(K() % 7 != 0, (K() % 10) / 10.0).cast("double").alias("groundedness"))


def fix_labels(spark, d):
    o = D.load(spark, d, "orders")
    none = F.array().cast("array<string>")
    pr = F.col("o_orderpriority")
    return o.select(
        K().alias("case_id"), (pr != "4-NOT SPECIFIED").alias("is_answerable"), D.cat("=own", C() % 5).alias("owning_repo"),
        F.when(F.col("o_orderstatus") == "F", "crash").when(F.col("o_orderstatus") == "O", "functional").alias("bug_kind"),
        F.lit(None).cast("string").alias("negative_class"),
        F.when(pr == "5-LOW", none).when(pr == "1-URGENT", F.array(path(C() % 3), path(F.lit(1)))).otherwise(F.array(path(C() % 3))).alias("expected_files"),
        F.when(K() % 4 == 0, none).otherwise(F.array(D.cat("=call", C() % 3), F.lit("util"))).alias("required_apis"))


def p(i: str, root: str = "app/src/main/java/") -> str:
    return f"'{root}org/acme/m' || (o_custkey % 97) || '/F' || ({i}) || '.java'"


def sql_records(shift: int, name: str) -> str:
    at = f"(o_orderkey + {shift}) % 3"
    return f"""{name} AS (SELECT o_orderkey AS case_id, o_custkey AS c, o_orderkey AS k, [{p(at)}, {p('o_custkey % 3')}, {p('(o_orderkey + o_custkey) % 3')}] AS loc,
  '--- a/x' || chr(10) || '+++ b/' || {p(at)} || chr(10) || '@@' || chr(10) || '+  call' || ({at}) || '();' || chr(10) ||
  CASE WHEN o_orderkey % 5 = 0 THEN '+  // util later' ELSE '+  util();' END AS diff, {p(at)} AS target,
  o_orderstatus <> 'P' AS emitted, o_totalprice > 150000 AS applies, round(o_totalprice / 1000) / 1000 AS cost, o_orderkey % 6 <> 0 AS planned,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS gnd, o_orderpriority <> '4-NOT SPECIFIED' AS answerable,
  CASE o_orderpriority WHEN '5-LOW' THEN [] WHEN '1-URGENT' THEN list_distinct([{p('o_custkey % 3')}, {p('1')}]) ELSE [{p('o_custkey % 3')}] END AS gold,
  CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE ['call' || (o_custkey % 3), 'util'] END AS apis FROM orders),
{name}_l AS (SELECT *, list_filter(string_split(diff, chr(10)), lambda s: starts_with(s, '+') AND NOT starts_with(s, '+++')) AS added FROM {name}),
{name}_r AS (SELECT *, len(gold) > 0 AS hf, len(apis) > 0 AS ha,
  len(list_filter(gold, lambda g: list_contains(loc[1:1], g)))::DOUBLE / nullif(len(gold), 0) AS r1,
  len(list_filter(gold, lambda g: list_contains(loc[1:3], g)))::DOUBLE / nullif(len(gold), 0) AS r3,
  len(list_filter(apis, lambda a: len(list_filter(added, lambda s: regexp_matches(s, '\\b' || a || '\\b'))) = 0)) = 0 AS pass,
  len(list_filter(apis, lambda a: len(list_filter(added, lambda s: NOT contains(s, '//') AND regexp_matches(s, '\\b' || a || '\\b'))) = 0)) = 0 AS code,
  list_contains(gold, target) AS touched FROM {name}_l),
{name}_f AS (SELECT *, CASE WHEN ha THEN pass END AS api_pass, CASE WHEN hf AND ha THEN applies AND r1 > 0 AND pass END AS resolved,
  CASE WHEN hf AND ha THEN applies AND touched AND code END AS strict, applies AND hf AND coalesce(r1, 0) > 0 AS correct,
  CASE WHEN planned THEN gnd END AS groundedness, CASE WHEN planned AND hf THEN touched::INT / len(gold)::DOUBLE END AS pr,
  CASE WHEN planned AND ha THEN 0.5::DOUBLE END AS pam FROM {name}_r)"""


@query("fix_cases", f"""WITH {sql_records(0, 'b')} SELECT case_id, round(r1, 6) AS file_recall_1, round(r3, 6) AS file_recall_3, api_pass, resolved,
  strict AS resolved_strict, correct, groundedness, round(pr, 6) AS plan_recall_1, pam AS plan_api_match FROM b_f""")
def fix_cases(spark, d):
    return rounded(fix_rows(spark, d)).select("case_id", "file_recall_1", "file_recall_3", "api_pass", "resolved", "resolved_strict", "correct",
                                              "groundedness", "plan_recall_1", "plan_api_match")


def fix_rows(spark, d, shift: int = 0, arm: str = "base"):
    return grading.fix_rows(fix_records(spark, d, shift, arm), fix_labels(spark, d))


def sql_fix_card(name: str) -> str:
    phi = ("avg(CASE WHEN emitted AND answerable AND correct THEN 1.0 WHEN emitted THEN -{c} WHEN answerable THEN 0.0 ELSE 1.0 END::DOUBLE)")
    lo, hi = sql_wilson("round_even(avg(resolved::INT) * count(resolved), 0)", "count(resolved)")
    return f"""SELECT count(*) AS n, avg(emitted::INT) AS fix_coverage, avg((NOT emitted)::INT) AS abstain_rate, avg(r1) AS file_recall_1, avg(r3) AS file_recall_3,
  avg(r3) AS file_recall_5, avg(api_pass::INT) AS required_api_pass_rate, avg(resolved::INT) AS resolved_rate, avg(strict::INT) AS resolved_rate_strict,
  avg(groundedness) AS plan_groundedness, avg(pr) AS plan_target_recall_1, avg(pr) AS plan_target_recall_5, avg(pam) AS plan_api_match,
  avg(applies::INT) FILTER (WHERE emitted) AS patch_apply_rate, count(*) FILTER (WHERE hf AND ha) AS n_gradeable, count(*) FILTER (WHERE NOT (hf AND ha)) AS n_excluded,
  avg((emitted AND applies)::INT) FILTER (WHERE NOT answerable) AS fabrication_rate, {', '.join(f"{phi.format(c=c)} AS phi_{grading.tag(c)}" for c in grading.CS)},
  sum(cost) AS cost_total, sum(cost) / nullif(count(*) FILTER (WHERE resolved), 0) AS cost_per_solved, {lo} AS resolved_lo, {hi} AS resolved_hi,
  count(resolved) AS resolved_rate_n FROM {name}_f"""


CARD_COLS = ("fix_coverage abstain_rate file_recall_1 file_recall_3 file_recall_5 required_api_pass_rate resolved_rate resolved_rate_strict plan_groundedness "
             "plan_target_recall_1 plan_target_recall_5 plan_api_match patch_apply_rate fabrication_rate phi_0_5 phi_1_0 phi_2_0 cost_total cost_per_solved "
             "resolved_lo resolved_hi").split()


@query("fix_scorecard", f"""WITH {sql_records(0, 'b')}, {sql_records(1, 'h')},
c AS (SELECT 'base' AS arm, * FROM ({sql_fix_card('b')}) UNION ALL SELECT 'head', * FROM ({sql_fix_card('h')}))
SELECT arm, n, n_gradeable, n_excluded, resolved_rate_n, {', '.join(f'round({c}, 6) AS {c}' for c in CARD_COLS)} FROM c""")
def fix_scorecard(spark, d):
    rows = fix_rows(spark, d).unionByName(fix_rows(spark, d, 1, "head"))
    return rounded(grading.fix_scorecard(rows).select("arm", "n", "n_gradeable", "n_excluded", "resolved_rate_n", *CARD_COLS))


@query("resolved_changes", f"""WITH {sql_records(0, 'b')}, {sql_records(1, 'h')}
SELECT case_id, CASE WHEN NOT b.resolved AND h.resolved THEN 'newly_solved' ELSE 'newly_broken' END AS change FROM b_f b JOIN h_f h USING (case_id)
WHERE b.resolved <> h.resolved""")
def resolved_changes(spark, d):
    return grading.resolved_diff(fix_rows(spark, d), fix_rows(spark, d, 1, "head"))


DELTA_SQL = f"""WITH {sql_records(0, 'b')}, {sql_records(1, 'h')}, bc AS ({sql_fix_card('b')}), hc AS ({sql_fix_card('h')}),
ch AS (SELECT count(*) FILTER (WHERE NOT b.resolved AND h.resolved) AS ns, count(*) FILTER (WHERE b.resolved AND NOT h.resolved) AS nb FROM b_f b JOIN h_f h USING (case_id)),
dl AS (SELECT ns, nb, h.file_recall_1 - b.file_recall_1 AS dfr, h.fabrication_rate - b.fabrication_rate AS dfab, h.cost_per_solved - b.cost_per_solved AS dcost,
   h.plan_target_recall_1 - b.plan_target_recall_1 AS dtr, h.resolved_rate_strict - b.resolved_rate_strict AS drs, h.plan_groundedness - b.plan_groundedness AS dgnd,
   h.phi_0_5 - b.phi_0_5 AS p05, h.phi_1_0 - b.phi_1_0 AS p10, h.phi_2_0 - b.phi_2_0 AS p20 FROM bc b, hc h, ch)"""
POS = "(coalesce(dfr, 0) > 0 OR ns > nb)"
WLO = sql_wilson("ns", "ns + nb")[0]


def cards(spark, d):
    b, h = fix_rows(spark, d), fix_rows(spark, d, 1, "head")
    return grading.fix_scorecard(b), grading.fix_scorecard(h), grading.resolved_diff(b, h)


@query("accept_plain", f"""{DELTA_SQL} SELECT {POS} AND coalesce(dfab, 0) <= 0 AND coalesce(dcost <= 0.5, true) AS accepted, {POS} AS pos_ok, coalesce(dfab, 0) <= 0 AS honesty_ok,
  coalesce(dcost <= 0.5, true) AS cost_ok, ns AS newly_solved, nb AS newly_broken FROM dl""")
def accept_plain(spark, d):
    return grading.accept(*cards(spark, d), cost_budget=0.5).drop("reasons")


@query("accept_grounded", f"""{DELTA_SQL}, v AS (SELECT coalesce(dtr, 0) > 0 OR coalesce(drs, 0) > 0 AS p, coalesce(dfab, 0) <= 0 AND coalesce(dgnd, 0) >= 0 AS h FROM dl)
SELECT p AND h AS accepted, p AS pos_ok, h AS honesty_ok, true AS cost_ok,
  concat_ws('; ', CASE WHEN NOT p THEN 'no grounded lift' END, CASE WHEN NOT h THEN 'honesty regressed' END) AS reasons FROM v""")
def accept_grounded(spark, d):
    return grading.accept_grounded(*cards(spark, d)).withColumn("reasons", F.array_join("reasons", "; "))


@query("accept_strengthened", f"""{DELTA_SQL} SELECT {POS} AND coalesce(dfab, 0) <= 0 AND p05 >= 0 AND p10 >= 0 AND p20 >= 0 AND {WLO} > 0 AS accepted, {POS} AS pos_ok,
  p05 >= 0 AND p10 >= 0 AND p20 >= 0 AS phi_ok, round({WLO}, 6) AS wilson_lo FROM dl""")
def accept_strengthened(spark, d):
    return rounded(grading.accept_strengthened(*cards(spark, d)).select("accepted", "pos_ok", "phi_ok", "wilson_lo"))


@query("e2e_funnel", f"""WITH {sql_records(0, 'b')}, c AS ({sql_fix_card('b')}), m AS (SELECT avg((k % 5 = c % 5)::INT) AS matched FROM b)
SELECT unnest(['match', 'localize', 'localize', 'fix', 'fix', 'fix']) AS stage, unnest(['matched', 'file@1', 'file@5', 'patch_applies', 'resolved_strict', 'required_api_pass']) AS metric,
  round(unnest([matched, file_recall_1, file_recall_5, patch_apply_rate, resolved_rate_strict, required_api_pass_rate]), 6) AS value FROM c, m""")
def e2e_funnel(spark, d):
    match = D.load(spark, d, "orders").select(K().alias("case_id"), (K() % 5 == C() % 5).alias("match"))
    return rounded(grading.funnel(grading.fix_scorecard(fix_rows(spark, d)), match))


# --- run records -------------------------------------------------------------------------------------

def runs(spark, d, shift: int = 0):
    rec = fix_records(spark, d, shift)
    o = D.load(spark, d, "orders")
    own = [D.cat("=own", (K() + shift + i) % 5) for i in range(3)]
    extra = o.select(K().alias("case_id"), F.array(*own).alias("ranked"), own[0].alias("chosen"), (K() % 8 != 0).alias("source_present"),
                     F.lit("plan").alias("fixer"), (K() % 2 == 0).alias("bound"))
    return rec.drop("arm", "plan", "groundedness").join(extra, "case_id")


def isolated(spark, d):
    return D.load(spark, d, "orders").select(K().alias("case_id"), F.array(path(K() % 2, "lib/src/java/"), path(C() % 3, "src/java/")).alias("retrieved"))


def sql_runs(shift: int, name: str) -> str:
    iso = f"['org/acme/m' || (c % 97) || '/F' || (k % 2) || '.java', 'org/acme/m' || (c % 97) || '/F' || (c % 3) || '.java']"
    can = "list_transform(gold, lambda g: replace(g, 'app/src/main/java/', ''))"
    return f"""{sql_records(shift, name)}, {name}_g AS (SELECT f.*, CASE o_orderstatus WHEN 'F' THEN 'crash' WHEN 'O' THEN 'functional' END AS bug_kind,
  (((c - k - {shift}) % 5) + 5) % 5 AS off, k % 8 <> 0 AS present, {iso} AS iso, {can} AS can FROM {name}_f f JOIN orders ON o_orderkey = k),
{name}_h AS (SELECT *, CASE WHEN off < 3 THEN off + 1 ELSE 0 END AS rank, CASE WHEN hf THEN len(list_filter(can, lambda g: list_contains(iso[1:1], g)))::DOUBLE / len(can) END AS i1,
  CASE WHEN hf THEN len(list_filter(can, lambda g: list_contains(iso, g)))::DOUBLE / len(can) END AS i5,
  CASE WHEN NOT present THEN 'ungradeable(no_source)' WHEN applies THEN 'applies' ELSE 'unappliable' END AS fix FROM {name}_g)"""


@query("graded_runs", f"""WITH {sql_runs(0, 'b')} SELECT case_id, bug_kind, CAST(rank AS INTEGER) AS rank, round(r1, 6) AS as_run_1, round(r3, 6) AS as_run_5,
  round(i1, 6) AS isolated_1, round(i5, 6) AS isolated_5, fix FROM b_h""")
def graded_runs(spark, d):
    return rounded(run_cases(spark, d)).select("case_id", "bug_kind", "rank", "as_run_1", "as_run_5", "isolated_1", "isolated_5", "fix")


def run_cases(spark, d, shift: int = 0):
    return grading.run_cases(runs(spark, d, shift), fix_labels(spark, d), isolated(spark, d))


def sql_run_card(name: str, kind: str, where: str) -> str:
    return f"""SELECT {kind} AS bug_kind, count(*) AS n, round(avg((rank = 1)::INT), 6) AS recall_1, round(avg((rank BETWEEN 1 AND 3)::INT), 6) AS recall_3, round(avg(rank), 6) AS mean_rank,
  round(avg(r1), 6) AS as_run_1, round(avg(i1), 6) AS isolated_1, count(*) FILTER (WHERE present) AS n_with_source, count(*) FILTER (WHERE NOT present) AS n_no_source,
  round(avg(strict::INT) FILTER (WHERE present), 6) AS resolved_rate_strict, round(avg(applies::INT) FILTER (WHERE present AND NOT answerable), 6) AS fabrication_rate,
  round(avg(applies::INT) FILTER (WHERE present), 6) AS patch_apply_rate FROM {name}_h {where}"""


@query("run_scorecard", f"""WITH {sql_runs(0, 'b')} {sql_run_card('b', 'NULL::VARCHAR', '')} UNION ALL
{sql_run_card('b', 'bug_kind', 'WHERE bug_kind IS NOT NULL GROUP BY bug_kind')}""")
def run_scorecard(spark, d):
    return rounded(grading.run_card(run_cases(spark, d))).select(
        "bug_kind", "n", "recall_1", "recall_3", "mean_rank", "as_run_1", "isolated_1", "n_with_source", "n_no_source", "resolved_rate_strict",
        "fabrication_rate", "patch_apply_rate")


@query("run_regressions", f"""WITH {sql_runs(0, 'b')}, {sql_runs(1, 'h')} SELECT case_id FROM h_h c JOIN b_h p USING (case_id)
WHERE (p.r1 = 1 AND coalesce(c.r1, 0) < 1) OR (p.fix = 'applies' AND c.fix <> 'applies')""")
def run_regressions(spark, d):
    return grading.regressions(run_cases(spark, d, 1), run_cases(spark, d))


@query("single_scores", f"""WITH {sql_runs(0, 'b')} SELECT case_id, (rank = 1)::INT::DOUBLE AS repo_recall_1, CAST(rank AS INTEGER) AS repo_rank,
  round(coalesce(r3, 0), 6) AS localization_recall, k % 2 = 0 AS bound FROM b_h""")
def single_scores(spark, d):
    return rounded(grading.single_score(runs(spark, d), fix_labels(spark, d)))


@query("promotion_notes", f"""WITH {sql_runs(0, 'b')}, c AS ({sql_run_card('b', 'NULL', '')}), n AS (SELECT count(strict) AS n FROM b_h WHERE present)
SELECT printf('PROMOTION-ELIGIBLE: plan fixer resolved_rate=%.2f over %d cases', resolved_rate_strict, n.n) AS note FROM c, n""")
def promotion_notes(spark, d):
    cases = run_cases(spark, d)
    return grading.promotion_notes(cases, grading.run_card(cases))


@query("token_costs", """
WITH u AS (SELECT event_id AS call_id, event_type AS model, event_id * 10 AS input_tokens, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS output_tokens FROM events),
pr AS (SELECT DISTINCT event_type AS model, length(event_type) / 10.0::DOUBLE AS ip, length(event_type)::DOUBLE AS op FROM events WHERE event_type <> 'view')
SELECT call_id, model, input_tokens, output_tokens, round(input_tokens / 1e6 * coalesce(ip, 0) + output_tokens / 1e6 * coalesce(op, 0), 9) AS cost_usd FROM u LEFT JOIN pr USING (model)""")
def token_costs(spark, d):
    e = D.load(spark, d, "events")
    raw = D.cat('={"usage": {"input_tokens": ', F.col("event_id") * 10, '=, "output_tokens": ', F.regexp_extract("props", r"(\d+)", 1), '=}, "total_cost_usd": 0.5}')
    prices = e.where("event_type <> 'view'").select(F.col("event_type").alias("model"), (F.length("event_type") / 10).alias("input_price"),
                                                    F.length("event_type").cast("double").alias("output_price")).distinct()
    out = grading.token_costs(e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("model"), raw.alias("raw")), prices)
    return out.select("call_id", "model", "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query("arm_probe", f"""WITH {sql_records(0, 'b')},
h AS (SELECT (k % 5 = c % 5)::INT AS m, len(list_filter(gold, lambda g: split_part(g, '/', -1) = split_part(loc[1], '/', -1))) > 0 AS s,
  len(list_filter(gold, lambda g: split_part(g, '/', -1) = split_part(loc[2], '/', -1))) > 0 AS t FROM b)
SELECT count(*) AS n, round(avg(m), 6) AS match_1, round(avg(s::INT), 6) AS file_1_summary, round(avg(t::INT), 6) AS file_1_tokens FROM h""")
def arm_probe(spark, d):
    r = runs(spark, d)
    files = lambda i: r.select("case_id", F.get("locations", F.lit(i)).alias("file"), F.lit(1).alias("rank"))
    ranking = r.select("case_id", F.col("chosen").alias("repo"), F.lit(1).alias("rank"))
    return rounded(grading.arm_probe(ranking, files(0), files(1), fix_labels(spark, d)))


# --- plans and context -------------------------------------------------------------------------------

@query("parsed_plans", f"""WITH t AS (SELECT o_orderkey AS case_id, o_orderkey % 5 AS v, {p('o_orderkey % 3')} AS f FROM orders)
SELECT case_id, v NOT IN (3, 4) AS parsed, CASE WHEN v IN (0, 1) THEN f || ':sym' WHEN v = 2 THEN f || ':' ELSE '' END AS targets,
  CASE WHEN v = 0 THEN 0.25 WHEN v IN (1, 2) THEN 0.0 END::DOUBLE AS confidence, CASE WHEN v = 1 THEN true WHEN v IN (0, 2) THEN false END AS abstain FROM t""")
def parsed_plans(spark, d):
    f, v = path(K() % 3), K() % 5
    obj = D.cat('={"root_cause": "x", "targets": [{"file": "', f, '=", "symbol": "sym"}], ')
    reply = (F.when(v == 0, D.cat("=text ```json\n", obj, '="confidence": 0.25}\n``` end'))
             .when(v == 1, D.cat("=so: ", obj, '="confidence": "high", "abstain": true} ok'))
             .when(v == 2, D.cat('={"targets": ["', f, '="], "required_apis": "oops"}')).when(v == 3, D.cat("=```json\n", obj, "=\n```")).otherwise("no plan"))
    plan = D.load(spark, d, "orders").select(K().alias("case_id"), X.parse_plan(reply).alias("p"))
    targets = F.array_join(F.transform("p.targets", lambda t: F.concat(t["file"], F.lit(":"), F.coalesce(t["symbol"], F.lit("")))), ",")
    return plan.select("case_id", F.col("p").isNotNull().alias("parsed"), F.coalesce(targets, F.lit("")).alias("targets"),
                       F.col("p.confidence").alias("confidence"), F.col("p.abstain").alias("abstain"))


@query("grounded_plans", f"""WITH {sql_records(0, 'b')},
sf AS (SELECT DISTINCT 'app/src/main/java/org/acme/' || CASE WHEN p_partkey % 97 > 9 THEN 'm' ELSE 'other' END || (p_partkey % 97) || '/F' || (p_size % 3) || '.java' AS file, p_size % 3 AS s FROM part),
j AS (SELECT case_id, planned, s IS NOT NULL AS here, k % 3 AS spot, c % 3 AS api FROM b LEFT JOIN sf ON file = target)
SELECT case_id, false AS ok, CASE WHEN planned THEN 3 ELSE 0 END::BIGINT AS n_citations, CASE WHEN planned AND here THEN 2 ELSE 0 END::BIGINT AS n_resolved,
  round(CASE WHEN planned AND here THEN 2.0 / 3 ELSE 0 END::DOUBLE, 6) AS groundedness,
  CASE WHEN NOT planned THEN 'unparseable_plan' WHEN here THEN 'api_unresolved:CALL' || api ELSE
    'api_unresolved:CALL' || api || ';symbol_unresolved:call' || spot || ';target_file_missing:' || (SELECT target FROM b x WHERE x.case_id = j.case_id) END AS failures FROM j""")
def grounded_plans(spark, d):
    rec = fix_records(spark, d).select("case_id", F.lit("r").alias("repo"), "plan", F.col("locations").alias("candidates"))
    part = D.load(spark, d, "part")
    folder = F.when(F.col("p_partkey") % 97 > 9, "m").otherwise("other")  # no plan names a file of the other folders
    s = F.col("p_size") % 3
    files = part.select(F.lit("r").alias("repo"), D.cat("=app/src/main/java/org/acme/", folder, F.col("p_partkey") % 97, "=/F", s, "=.java").alias("file"),
                        D.cat("=void call", s, "=() {}").alias("text")).distinct()
    return rounded(context.check_plans(rec, files)).withColumn("failures", F.array_join("failures", ";")).withColumns(
        {"n_citations": F.col("n_citations").cast("long"), "n_resolved": F.col("n_resolved").cast("long")})


ENT_SQL = """ent AS (SELECT 'r' AS repo, p_partkey AS ord, 'mod' || (p_size % 12) AS module, 'wiki/mod' || (p_size % 12) || '.md' AS page, 'src/P' || (p_partkey % 40) || '.java' AS file FROM part)"""


def entities(spark, d):
    size = F.col("p_size") % 12
    return D.load(spark, d, "part").select(F.lit("r").alias("repo"), F.col("p_partkey").alias("ord"), D.cat("=mod", size).alias("module"),
                                           D.cat("=wiki/mod", size, "=.md").alias("wiki_page"), D.cat("=src/P", F.col("p_partkey") % 40, "=.java").alias("file"))


def doc_sections(spark, d):
    return D.load(spark, d, "documents").select(F.lit("r").alias("repo"), D.cat("=mod", F.floor(F.col("doc_id") / 12)).alias("module"), F.col("doc_id").alias("ord"), "text")


@query("module_docs", """SELECT 'mod' || (doc_id // 12) AS module, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS doc_md5 FROM documents WHERE text <> '' GROUP BY 1""")
def module_docs(spark, d):
    return context.module_docs(doc_sections(spark, d)).select("module", F.md5("doc").alias("doc_md5"))


@query("candidate_pools", f"""WITH {ENT_SQL}, mf AS (SELECT module, file, min(ord) AS ord FROM ent GROUP BY 1, 2),
hit AS (SELECT o_custkey AS qid, o_orderkey AS rank, o_orderstatus = 'F' AS doc, 'src/P' || (o_orderkey % 40) || '.java' AS file, 'mod' || (o_orderkey % 15) AS module, o_orderpriority AS snip FROM orders),
rows_ AS (SELECT qid, rank, 0 AS pos, file, NULL AS wiki FROM hit WHERE NOT doc UNION ALL
  SELECT qid, rank, row_number() OVER (PARTITION BY qid, rank ORDER BY ord) - 1, m.file, snip FROM hit h JOIN mf m USING (module) WHERE doc),
pool AS (SELECT qid, file, min(rank * 1000000 + pos) AS spot, arg_min(wiki, rank * 1000000 + pos) FILTER (WHERE wiki IS NOT NULL) AS wiki FROM rows_ GROUP BY 1, 2)
SELECT qid, file, wiki, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, file) AS rank FROM pool) WHERE rank <= 20""")
def candidate_pools(spark, d):
    o = D.load(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "doc").otherwise("symbol")
    file = F.when(F.col("o_orderstatus") == "F", "none.md").otherwise(D.cat("=src/P", K() % 40, "=.java"))
    hits = o.select(C().alias("qid"), K().alias("rank"), F.lit("r").alias("repo"), kind.alias("kind"), file.alias("file"), D.cat("=mod", K() % 15).alias("module"),
                    F.col("o_orderpriority").alias("snippet"))
    return context.candidate_pool(hits, context.module_lut(entities(spark, d))).withColumn("rank", F.col("rank").cast("long"))


@query("context_blocks", f"""WITH src AS (SELECT DISTINCT 'src/P' || (p_partkey % 40) || '.java' AS file FROM part)
SELECT o_orderkey AS qid, 'src/P' || (o_orderkey % 80) || '.java' AS file, CASE WHEN s.file IS NOT NULL THEN 'SOURCE:' || chr(10) || 'code of ' || s.file ELSE 'SOURCE:' || chr(10) || o_orderpriority END
  || CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'WIKI:' || chr(10) || 'wiki ' || o_custkey ELSE '' END
  || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'GRAPH:' || chr(10) || 'calls: C' || o_custkey ELSE '' END AS context
FROM orders LEFT JOIN src s ON s.file = 'src/P' || (o_orderkey % 80) || '.java'""")
def context_blocks(spark, d):
    o = D.load(spark, d, "orders")
    file = D.cat("=src/P", K() % 80, "=.java")
    pool = o.select(K().alias("qid"), F.lit("r").alias("repo"), file.alias("file"), F.col("o_orderpriority").alias("snippet"),
                    F.when(F.col("o_orderstatus") == "F", D.cat("=wiki ", C())).alias("wiki"))
    part = D.load(spark, d, "part")
    sf = D.cat("=src/P", F.col("p_partkey") % 40, "=.java")
    sources = part.select(F.lit("r").alias("repo"), sf.alias("file"), D.cat("=code of ", sf).alias("text")).distinct()
    bits = o.where(C() % 2 == 0).select(K().alias("qid"), file.alias("file"), D.cat("=calls: C", C()).alias("bits"))
    return context.context_blocks(pool, sources, bits, 800)


@query("file_documents", f"""WITH {ENT_SQL}, fm AS (SELECT file, arg_min(module, ord) AS module FROM ent GROUP BY 1),
ds AS (SELECT 'mod' || (doc_id // 12) AS module, trim(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS doc FROM documents GROUP BY 1),
fl AS (SELECT o_custkey AS case_id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x/' END || 'src/P' || (o_orderkey % 50) || '.java' AS file,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
j AS (SELECT case_id, pos, fl.file, doc, row_number() OVER (PARTITION BY case_id, doc ORDER BY pos) AS k FROM fl JOIN fm ON split_part(fm.file, '/', -1) = split_part(fl.file, '/', -1)
   JOIN ds USING (module) WHERE rn <= 6)
SELECT case_id, pos, md5('## ' || file || chr(10) || substr(doc, 1, 800)) AS block_md5 FROM j WHERE k = 1""")
def file_documents(spark, d):
    o = D.load(spark, d, "orders")
    file = D.cat(F.when(K() % 2 == 0, "").otherwise("x/"), "=src/P", K() % 50, "=.java")
    files = o.select(C().alias("case_id"), F.lit("r").alias("repo"), K().alias("pos"), file.alias("file"))
    return context.file_docs(files, entities(spark, d), doc_sections(spark, d), 800, 6).select("case_id", "pos", F.md5("block").alias("block_md5"))


@query("symbol_contexts", """
WITH e AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'X' END || c_custkey AS a, 'N' || c_nationkey AS b FROM customer),
bo AS (SELECT a AS s, b AS n FROM e UNION SELECT b, a FROM e),
nb AS (SELECT s, string_agg(n, ', ' ORDER BY n) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n) AS r FROM bo) WHERE r <= 8 GROUP BY 1),
sy AS (SELECT o_clerk AS case_id, s, min(pos) AS pos FROM (SELECT o_custkey % 300 AS o_clerk, 'C' || o_custkey AS s, o_orderkey AS pos FROM orders) GROUP BY 1, 2),
tx AS (SELECT case_id, s, pos, concat_ws(chr(10), CASE WHEN c_acctbal > 5000 THEN 'source:' || chr(10) || c_name END, 'calls: ' || calls) AS body
   FROM sy LEFT JOIN nb USING (s) LEFT JOIN customer ON 'C' || c_custkey = s)
SELECT case_id, rank, '## ' || s || chr(10) || body AS block FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS rank FROM tx WHERE body <> '') WHERE rank <= 4""")
def symbol_contexts(spark, d):
    c = D.load(spark, d, "customer")
    name = D.cat("=C", "c_custkey")
    caller = D.cat(F.when(F.col("c_custkey") % 2 == 0, "C").otherwise("X"), "c_custkey")  # no case asks for an X
    edges = c.select(caller.alias("caller"), D.cat("=N", "c_nationkey").alias("callee"))
    snippets = c.select(name.alias("symbol"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("snippet"))
    symbols = D.load(spark, d, "orders").select((C() % 300).alias("case_id"), K().alias("pos"), D.cat("=C", C()).alias("symbol"))
    return context.symbol_context(symbols, snippets, edges, 800, 4, 8).withColumn("rank", F.col("rank").cast("long"))
