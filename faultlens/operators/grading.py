"""Scorecards, fault and fix grading, card comparison and acceptance.

Labels enter only here. Predictions are match records (case_id, arm, ranked_names, scores, predicted,
margin, top1_score); labels are (case_id, owning_repo, is_answerable, negative_class, bug_kind,
expected_files, required_apis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import diffs, metrics
from faultlens.functions import text as T
from faultlens.functions.metrics import count_where, ratio

KS = (1, 3, 5)
CS = (0.5, 1.0, 2.0)


def tag(c: float) -> str:
    return str(c).replace(".", "_")


def per_case(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Each prediction joined with its label and graded."""
    lab = labels.select("case_id", "owning_repo", F.coalesce("is_answerable", F.lit(True)).alias("answerable"),
                        "negative_class", "bug_kind")
    top = F.get("ranked_names", F.lit(0))
    answered = F.col("predicted").isNotNull()
    return records.join(lab, "case_id").select(
        "case_id", "arm", "owning_repo", "predicted", top.alias("ranked_top1"),
        metrics.rank_of(F.col("ranked_names"), F.col("owning_repo")).alias("oracle_rank"),
        F.coalesce(top == F.col("owning_repo"), F.lit(False)).alias("recall_1"), answered.alias("answered"),
        F.coalesce(answered & (F.col("predicted") == F.col("owning_repo")), F.lit(False)).alias("correct"),
        "answerable", "margin", "top1_score", "negative_class", "bug_kind")


def _card() -> list[Column]:
    n, rank = F.count("*"), F.col("oracle_rank")
    answered, answerable, correct = F.col("answered"), F.col("answerable"), F.col("correct")
    found = answerable & (rank > 0)
    na, n_ans = count_where(answerable), count_where(answered)
    n_un = count_where(~answerable)
    out = [n.alias("n"), na.alias("n_answerable")]
    for k in KS:
        hits = count_where(found & (rank <= k))
        lo, hi = metrics.wilson(hits, na)
        out += [ratio(hits, na).alias(f"recall_{k}"), lo.alias(f"recall_{k}_lo"), hi.alias(f"recall_{k}_hi")]
    out += [ratio(F.coalesce(F.sum(F.when(found, 1.0 / rank)), F.lit(0.0)), na).alias("mrr"),
            F.coalesce(F.avg(F.when(found, rank)), F.lit(0.0)).alias("mean_rank"),
            ratio(n_ans, n).alias("coverage"),
            ratio(count_where(correct), n_ans).alias("selective_accuracy"),
            F.when(n_ans > 0, 1.0 - ratio(count_where(correct), n_ans)).otherwise(0.0).alias("selective_risk")]
    out += [F.avg(metrics.reliability(answered, answerable, correct, c)).alias(f"phi_{tag(c)}") for c in CS]
    out += [ratio(count_where(~answerable & ~answered), n_un, None).alias("abstention_recall"),
            n_un.alias("n_unanswerable")]
    return out


def scorecard(graded: DataFrame) -> DataFrame:
    """Metrics per arm, and per arm and bug kind where the kind is known; bug_kind null is the arm."""
    sets = graded.withColumn("kind", F.explode(F.when(
        F.coalesce("bug_kind", F.lit("")) != "", F.array(F.lit(None).cast("string"), F.col("bug_kind"))).otherwise(
        F.array(F.lit(None).cast("string")))))
    return sets.groupBy("arm", F.col("kind").alias("kind")).agg(*_card()).withColumnRenamed("kind", "bug_kind")


def abstain_by_class(graded: DataFrame) -> DataFrame:
    """Abstain rate per arm and negative class."""
    return graded.where(F.col("negative_class").isNotNull()).groupBy("arm", "negative_class").agg(
        F.count("*").alias("n"), count_where(~F.col("answered")).alias("abstained"),
        ratio(count_where(~F.col("answered")), F.count("*")).alias("abstain_rate"))


def fault_localization(records: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """frame@1, frame@k, file@1 and the no-fault count; labels is (case_id, fault_frame, fault_file)."""
    rows = records.join(labels, "case_id")
    none = (F.coalesce("confidence", F.lit("NONE")) == "NONE") | F.col("top_frame_key").isNull()
    f1 = ~none & (F.col("top_frame_key") == F.col("fault_frame"))
    fk = ~none & F.array_contains(F.slice("blamed_keys", 1, k), F.col("fault_frame"))
    fl = ~none & (F.coalesce("fault_file", F.lit("")) != "") & F.col("fault_file_hint").isNotNull() & (
        T.basename(F.col("fault_file")) == T.basename(F.col("fault_file_hint")))
    n = F.count("*")
    return rows.agg(n.alias("n"), ratio(count_where(f1), n).alias("frame_1"), ratio(count_where(fk), n).alias("frame_k"),
                    ratio(count_where(fl), n).alias("file_1"), count_where(none).alias("no_fault_found"))


def paths(c: Column, canonical: bool = False) -> Column:
    return F.transform(c, T.canonical_path if canonical else T.norm_path)


def fix_rows(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-case fix facts: recall, api pass, resolved loose and strict; null where not gradeable."""
    lab = labels.select("case_id", F.coalesce("is_answerable", F.lit(True)).alias("answerable"), "expected_files",
                        "required_apis")
    none = F.array().cast("array<string>")
    # each derived array is its own column, so it is built once per row and not once per metric
    r = records.join(lab, "case_id").withColumns({
        "_gold": F.array_distinct(paths(F.col("expected_files"))), "_loc": paths(F.col("locations")), "_added": diffs.added_lines(F.col("patch_diff")),
        "_touched": diffs.touched_files(F.col("patch_diff")), "_planned": paths(F.coalesce(F.col("plan.targets.file"), none)),
        "_named": F.transform(F.coalesce(F.col("plan.required_apis"), none), F.lower)})
    r = r.withColumns({
        "_pass": diffs.references_all(F.col("_added"), F.col("required_apis")),
        "_pass_code": diffs.references_all(diffs.code_lines(F.col("_added")), F.col("required_apis")),
        "_r1": metrics.recall_at_k(F.col("_loc"), F.col("_gold"), 1)})
    gold, loc, apis = F.col("_gold"), F.col("_loc"), F.col("required_apis")
    has_files, has_apis = F.size("expected_files") > 0, F.size(apis) > 0
    api_pass, api_code, r1 = F.col("_pass"), F.col("_pass_code"), F.col("_r1")
    touched = F.arrays_overlap("_touched", gold)
    gradeable = has_files & has_apis
    planned = F.col("plan").isNotNull()
    plan_files = F.col("_planned")
    api_match = F.size(F.filter(apis, lambda a: F.array_contains("_named", F.lower(a)))) / F.nullif(F.size(apis), F.lit(0))
    cols = [F.when(has_files, metrics.recall_at_k(loc, gold, k)).alias(f"file_recall_{k}") for k in KS]
    plan_cols = [F.when(planned & has_files, metrics.recall_at_k(plan_files, gold, k)).alias(f"plan_recall_{k}") for k in (1, 5)]
    return r.select(
        "case_id", "arm", "answerable", "patch_emitted", "patch_applies", "cost_usd", *cols,
        F.when(has_apis, api_pass).alias("api_pass"), gradeable.alias("gradeable"),
        F.when(gradeable, F.col("patch_applies") & (r1 > 0) & api_pass).alias("resolved"),
        F.when(gradeable, F.col("patch_applies") & touched & api_code).alias("resolved_strict"),
        (F.col("patch_applies") & has_files & (r1 > 0)).alias("correct"),
        F.when(planned, F.col("groundedness")).alias("groundedness"), *plan_cols,
        F.when(planned & has_apis, api_match).alias("plan_api_match"))


MEANS = {"file_recall_1": "file_recall_1", "file_recall_3": "file_recall_3", "file_recall_5": "file_recall_5",
         "required_api_pass_rate": "api_pass", "resolved_rate": "resolved", "resolved_rate_strict": "resolved_strict",
         "plan_groundedness": "groundedness", "plan_target_recall_1": "plan_recall_1",
         "plan_target_recall_5": "plan_recall_5", "plan_api_match": "plan_api_match"}


def fix_scorecard(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One wide aggregate per arm; a metric over an empty subset is null."""
    by = ["arm"] if by is None else by
    emitted, applies = F.col("patch_emitted"), F.col("patch_applies")
    n, n_emit = F.count("*"), count_where(emitted)
    unanswerable = ~F.col("answerable")
    fabricated = unanswerable & emitted & applies
    solved = count_where(F.col("resolved"))
    means = [F.avg(F.col(src).cast("double")).alias(name) for name, src in MEANS.items()]
    sizes = [F.count(F.col(src)).alias(f"{name}_n") for name, src in MEANS.items()]
    phis = [F.avg(metrics.reliability(emitted, F.col("answerable"), F.col("correct"), c)).alias(f"phi_{tag(c)}") for c in CS]
    card = rows.groupBy(*by).agg(
        n.alias("n"), ratio(n_emit, n).alias("fix_coverage"), ratio(n - n_emit, n).alias("abstain_rate"), *means, *sizes,
        ratio(count_where(emitted & applies), n_emit).alias("patch_apply_rate"),
        count_where(F.col("gradeable")).alias("n_gradeable"), count_where(~F.col("gradeable")).alias("n_excluded"),
        ratio(count_where(fabricated), count_where(unanswerable), None).alias("fabrication_rate"), *phis,
        F.sum("cost_usd").alias("cost_total"), ratio(F.sum("cost_usd"), solved, None).alias("cost_per_solved"))
    lo, hi = metrics.wilson(F.bround(F.col("resolved_rate") * F.col("resolved_rate_n")).cast("long"), F.col("resolved_rate_n"))
    some = F.col("resolved_rate_n") > 0
    return card.withColumns({"resolved_lo": F.when(some, lo), "resolved_hi": F.when(some, hi)})


def run_cases(runs: DataFrame, labels: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """Per-case grading of run records: rank, localize as run and isolated, and the fix state.

    runs is (case_id, ranked array<string>, chosen, locations, patch_diff, patch_applies,
    source_present, cost_usd, fixer); isolated is (case_id, retrieved) on the labelled repo.
    """
    lab = labels.select("case_id", "owning_repo", "bug_kind", "expected_files", "required_apis",
                        F.coalesce("is_answerable", F.lit(True)).alias("answerable"))
    r = runs.join(lab, "case_id")
    r = r.join(isolated, "case_id", "left") if isolated is not None else r.withColumn(
        "retrieved", F.lit(None).cast("array<string>"))
    has = F.size("expected_files") > 0
    r = r.withColumns({"_gold": F.array_distinct(paths(F.col("expected_files"), True)), "_run": paths(F.col("locations"), True),
                       "_iso": paths(F.coalesce("retrieved", F.array().cast("array<string>")), True)})
    gold, run_loc, iso_loc = F.col("_gold"), F.col("_run"), F.col("_iso")
    rank = metrics.rank_of(F.col("ranked"), F.col("owning_repo"))
    fix = (F.when(~F.col("source_present"), F.lit("ungradeable(no_source)"))
           .when(F.col("patch_applies"), F.lit("applies")).otherwise(F.lit("unappliable")))
    return r.select(
        "case_id", "bug_kind", "answerable", "owning_repo", "chosen", "fixer", "cost_usd", rank.alias("rank"),
        *[F.when(has, metrics.recall_at_k(run_loc, gold, k)).alias(f"as_run_{k}") for k in KS],
        *[F.when(has, metrics.recall_at_k(iso_loc, gold, k)).alias(f"isolated_{k}") for k in KS],
        fix.alias("fix"), "source_present", "patch_applies", "patch_diff", "locations", "expected_files", "required_apis")


def run_card(cases: DataFrame) -> DataFrame:
    """Overall (bug_kind null) and per-kind match, localize and fix metrics of graded runs."""
    gold = paths(F.col("expected_files"))
    emitted = F.trim(F.coalesce("patch_diff", F.lit(""))) != ""
    gradeable = F.col("source_present") & (F.size("expected_files") > 0) & (F.size("required_apis") > 0)
    touched = F.size(F.array_intersect(diffs.touched_files(F.col("patch_diff")), gold)) > 0
    code = diffs.references_all(diffs.code_added_lines(F.col("patch_diff")), F.col("required_apis"))
    strict = F.when(gradeable, F.col("patch_applies") & touched & code)
    rows = cases.withColumns({"_emitted": emitted, "_strict": strict}).withColumn("kind", F.explode(F.when(
        F.coalesce("bug_kind", F.lit("")) != "", F.array(F.lit(None).cast("string"), F.col("bug_kind"))).otherwise(
        F.array(F.lit(None).cast("string")))))
    n, rank, here = F.count("*"), F.col("rank"), F.col("source_present")
    fabricated = here & ~F.col("answerable") & F.col("_emitted") & F.col("patch_applies")
    return rows.groupBy(F.col("kind").alias("kind")).agg(
        n.alias("n"), *[ratio(count_where((rank > 0) & (rank <= k)), n).alias(f"recall_{k}") for k in KS],
        F.avg("rank").alias("mean_rank"), *[F.avg(f"as_run_{k}").alias(f"as_run_{k}") for k in KS],
        *[F.avg(f"isolated_{k}").alias(f"isolated_{k}") for k in KS],
        count_where(here).alias("n_with_source"), count_where(~here).alias("n_no_source"),
        F.avg(F.col("_strict").cast("double")).alias("resolved_rate_strict"),
        F.count("_strict").alias("resolved_rate_strict_n"),
        ratio(count_where(fabricated), count_where(here & ~F.col("answerable")), None).alias("fabrication_rate"),
        ratio(count_where(here & F.col("_emitted") & F.col("patch_applies")), count_where(here & F.col("_emitted")),
              None).alias("patch_apply_rate")).withColumnRenamed("kind", "bug_kind")


def single_score(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """One record's score: owner recall and rank, plain location recall, bound flag."""
    r = runs.join(labels.select("case_id", "owning_repo", "expected_files"), "case_id")
    gold = F.array_distinct("expected_files")
    loc = ratio(F.size(F.array_intersect("locations", gold)), F.size(gold))
    rank = metrics.rank_of(F.col("ranked"), F.col("owning_repo"))
    return r.select("case_id", (rank == 1).cast("double").alias("repo_recall_1"), rank.alias("repo_rank"),
                    loc.alias("localization_recall"), "bound")


EPS = 1e-9


def compare_cards(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Metric deltas of two long cards(metric, value) with the verdict on every row."""
    both = cur.select("metric", F.col("value").alias("cur")).join(
        prev.select("metric", F.col("value").alias("prev")), "metric", "full_outer")
    rows = both.withColumn("delta", F.col("cur") - F.col("prev"))
    tracked = F.col("metric").isin("recall_1", "as_run_5", "resolved_rate_strict")
    verdict = rows.where(tracked).agg(
        F.coalesce(F.bool_or(F.col("delta") < -EPS), F.lit(False)).alias("down"),
        F.coalesce(F.bool_or(F.col("delta") > EPS), F.lit(False)).alias("up")).select(
        F.when(F.col("down"), F.lit("regressed")).when(F.col("up"), F.lit("improved")).otherwise(F.lit("flat")).alias("verdict"),
        F.lit(1).alias("one"))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(verdict), "one").drop("one")


def regressions(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Cases of graded runs whose first location or applying fix was lost."""
    p = prev.select("case_id", F.col("as_run_1").alias("p_loc"), F.col("fix").alias("p_fix"))
    loc = (F.col("p_loc") == 1) & (F.coalesce("as_run_1", F.lit(0.0)) < 1)
    fix = (F.col("p_fix") == "applies") & (F.col("fix") != "applies")
    return cur.join(p, "case_id").where(F.coalesce(loc, F.lit(False)) | fix).select("case_id")


def long_card(card: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Wide metric columns as (by..., metric, value) rows."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in names)
    return card.select(*(by or []), F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))


def resolved_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Cases newly solved or newly broken between two (case_id, resolved); null never counts."""
    b, h = base.select("case_id", F.col("resolved").alias("b")), head.select("case_id", F.col("resolved").alias("h"))
    both = b.join(h, "case_id", "full_outer")
    change = F.when(~F.col("b") & F.col("h"), F.lit("newly_solved")).when(F.col("b") & ~F.col("h"), F.lit("newly_broken"))
    return both.select("case_id", change.alias("change")).where(F.col("change").isNotNull())


def _deltas(base: DataFrame, head: DataFrame, diff: DataFrame, names: list[str]) -> DataFrame:
    """One row: delta of each named metric plus the newly solved and broken counts."""
    b = base.select(*[F.col(m).alias(f"b_{m}") for m in names], F.lit(1).alias("one"))
    h = head.select(*[F.col(m).alias(f"h_{m}") for m in names], F.lit(1).alias("one"))
    n = diff.agg(count_where(F.col("change") == "newly_solved").alias("newly_solved"),
                 count_where(F.col("change") == "newly_broken").alias("newly_broken"), F.lit(1).alias("one"))
    return b.join(h, "one").join(n, "one").select(
        "newly_solved", "newly_broken", *[(F.col(f"h_{m}") - F.col(f"b_{m}")).alias(m) for m in names])


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for ok, text in pairs]))


def accept(base: DataFrame, head: DataFrame, diff: DataFrame, cost_budget: float | None = None) -> DataFrame:
    """Plain two-sided verdict over one-row fix cards: lift, honesty, cost."""
    d = _deltas(base, head, diff, ["file_recall_1", "fabrication_rate", "cost_per_solved"])
    pos = (F.coalesce("file_recall_1", F.lit(0.0)) > 0) | (F.col("newly_solved") > F.col("newly_broken"))
    honest = F.coalesce("fabrication_rate", F.lit(0.0)) <= 0
    cost = _cost_ok(cost_budget)
    return d.select(
        (pos & honest & cost).alias("accepted"), pos.alias("pos_ok"), honest.alias("honesty_ok"), cost.alias("cost_ok"),
        "newly_solved", "newly_broken",
        _reasons((pos, "no positive lift"), (honest, "fabrication_rate rose"), (cost, "cost_per_solved rose")).alias("reasons"))


def _cost_ok(cost_budget: float | None) -> Column:
    if cost_budget is None:
        return F.lit(True)
    return F.coalesce(F.col("cost_per_solved") <= cost_budget, F.lit(True))


def accept_grounded(base: DataFrame, head: DataFrame, diff: DataFrame, cost_budget: float | None = None) -> DataFrame:
    """Verdict on the plan signal: plan recall or strict resolution up, no less honest."""
    d = _deltas(base, head, diff, ["plan_target_recall_1", "resolved_rate_strict", "fabrication_rate",
                                   "plan_groundedness", "cost_per_solved"])
    pos = (F.coalesce("plan_target_recall_1", F.lit(0.0)) > 0) | (F.coalesce("resolved_rate_strict", F.lit(0.0)) > 0)
    honest = (F.coalesce("fabrication_rate", F.lit(0.0)) <= 0) & (F.coalesce("plan_groundedness", F.lit(0.0)) >= 0)
    cost = _cost_ok(cost_budget)
    return d.select(
        (pos & honest & cost).alias("accepted"), pos.alias("pos_ok"), honest.alias("honesty_ok"), cost.alias("cost_ok"),
        _reasons((pos, "no grounded lift"), (honest, "honesty regressed"), (cost, "cost_per_solved rose")).alias("reasons"))


def accept_strengthened(base: DataFrame, head: DataFrame, diff: DataFrame, cost_budget: float | None = None) -> DataFrame:
    """Plain verdict plus no reliability loss at any penalty and a Wilson lower bound above 0."""
    phis = [f"phi_{tag(c)}" for c in CS]
    d = _deltas(base, head, diff, ["file_recall_1", "fabrication_rate", "cost_per_solved", *phis])
    pos = (F.coalesce("file_recall_1", F.lit(0.0)) > 0) | (F.col("newly_solved") > F.col("newly_broken"))
    honest = F.coalesce("fabrication_rate", F.lit(0.0)) <= 0
    cost = _cost_ok(cost_budget)
    phi = F.lit(True)
    for p in phis:
        phi = phi & (F.col(p) >= 0)
    lo, _ = metrics.wilson(F.col("newly_solved"), F.col("newly_solved") + F.col("newly_broken"))
    return d.select(
        (pos & honest & phi & (lo > 0) & cost).alias("accepted"), pos.alias("pos_ok"), honest.alias("honesty_ok"),
        phi.alias("phi_ok"), lo.alias("wilson_lo"), cost.alias("cost_ok"),
        _reasons((pos, "no positive lift"), (honest, "fabrication_rate rose"), (cost, "cost_per_solved rose"),
                 (phi, "phi_c regressed"), (lo > 0, "newly-solved evidence too thin")).alias("reasons"))


def funnel(card: DataFrame, cases: DataFrame) -> DataFrame:
    """(stage, metric, value) rows of one fix card and the match flags of cases(case_id, match)."""
    match = cases.agg(F.avg(F.col("match").cast("double")).alias("matched"), F.lit(1).alias("one"))
    wide = card.withColumn("one", F.lit(1)).join(match, "one")
    return wide.select(F.expr(
        "stack(6, 'match', 'matched', matched, 'localize', 'file@1', file_recall_1, 'localize', 'file@5', file_recall_5, "
        "'fix', 'patch_applies', patch_apply_rate, 'fix', 'resolved_strict', resolved_rate_strict, "
        "'fix', 'required_api_pass', required_api_pass_rate) as (stage, metric, value)"))


def promotion_notes(cases: DataFrame, card: DataFrame) -> DataFrame:
    """A note when every case used the plan fixer and the strict rate has cases behind it."""
    used = cases.agg(F.min("fixer").alias("lo"), F.max("fixer").alias("hi"), F.lit(1).alias("one"))
    overall = card.where(F.col("bug_kind").isNull()).select(
        F.col("resolved_rate_strict").alias("v"), F.col("resolved_rate_strict_n").alias("n"), F.lit(1).alias("one"))
    ready = used.join(overall, "one").where((F.col("lo") == "plan") & (F.col("hi") == "plan") & (F.col("n") > 0))
    note = F.format_string("PROMOTION-ELIGIBLE: plan fixer resolved_rate=%.2f over %d cases", F.col("v"), F.col("n"))
    return ready.select(note.alias("note"))


def token_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per call from usage(call_id, model, raw JSON) and prices per 1e6 tokens; unknown model is 0."""
    def number(path: str) -> Column:
        return F.coalesce(F.get_json_object("raw", path).try_cast("double"), F.lit(0.0))
    rows = usage.withColumns({"input_tokens": number("$.usage.input_tokens").cast("long"),
                              "output_tokens": number("$.usage.output_tokens").cast("long"),
                              "reported": number("$.total_cost_usd")})
    priced = rows.join(prices, "model", "left")
    cost = (F.col("input_tokens") / 1e6 * F.coalesce("input_price", F.lit(0.0))
            + F.col("output_tokens") / 1e6 * F.coalesce("output_price", F.lit(0.0)))
    return priced.select("call_id", "model", "input_tokens", "output_tokens", cost.alias("cost_usd"), "reported")


def arm_probe(ranking: DataFrame, summary_files: DataFrame, token_files: DataFrame, labels: DataFrame) -> DataFrame:
    """match@1 and file@1 of the summary and token queries on the labelled repo.

    The file inputs are (case_id, file, rank); a hit shares the basename or one path ends the other.
    """
    def hit(files: DataFrame, name: str) -> DataFrame:
        gold = labels.select("case_id", F.explode("expected_files").alias("want"))
        pair = files.where(F.col("rank") == 1).join(gold, "case_id")
        same = ((T.basename(F.col("file")) == T.basename(F.col("want"))) | F.endswith("file", "want")
                | F.endswith("want", "file"))
        return pair.groupBy("case_id").agg(F.bool_or(same).cast("double").alias(name))

    top = ranking.where(F.col("rank") == 1).select("case_id", "repo")
    rows = (labels.select("case_id", "owning_repo").join(top, "case_id", "left")
            .join(hit(summary_files, "s"), "case_id", "left").join(hit(token_files, "t"), "case_id", "left"))
    match = F.coalesce((F.col("repo") == F.col("owning_repo")).cast("double"), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.avg(match).alias("match_1"), F.avg(F.coalesce("s", F.lit(0.0))).alias("file_1_summary"),
                    F.avg(F.coalesce("t", F.lit(0.0))).alias("file_1_tokens"))
