"""Mining: candidate filters, leak scrubbing and flags, authored-case checks, hold-out and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import diffs as X
from faultlens.functions import logs as L
from faultlens.functions import text as T
from faultlens.operators import faults, ranking
from faultlens.operators.lexical import top_k
from faultlens.session import cut, join_sized, with_ordinal


def production_files(files: Column) -> Column:
    """Production source paths of array<struct<filename, status, ...>>, order kept."""
    def keep(f: Column) -> Column:
        low = F.lower(f["filename"])
        rooted = T.has_any(low, [*V.PROD_ROOTS, "/src/"]) | low.startswith("src/")
        return (f["status"].isin(*V.PROD_STATUS) & T.ends_any(low, V.PROD_EXTENSIONS)
                & ~T.has_any(low, V.PROD_EXCLUDED) & rooted)

    return F.transform(F.filter(files, keep), lambda f: f["filename"])


def is_minable(merged: Column, title: Column, changed_files: Column, files: Column, max_files: int = 5) -> Column:
    """Merged, single-concern change that touches one to max_files files, one of them production."""
    revert = F.coalesce(title, F.lit("")).rlike(r"(?iU)^\s*(?:merge\b|revert\b|revert \")")
    n = F.coalesce(changed_files, F.size(files))
    return merged & ~revert & (n <= max_files) & (F.size(production_files(files)) >= 1)


def admit_e2e(body: Column, merge_sha: Column, files: Column, require_crash_log: bool, require_merged_fix: bool) -> Column:
    ok = F.lit(True)
    if require_crash_log:
        ok = ok & L.has_crash_signature(body)
    if require_merged_fix:
        ok = ok & (F.coalesce(merge_sha, F.lit("")) != "") & (F.size(production_files(files)) > 0)
    return ok


def candidates(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Issue nodes with their first merged closing change in the same repo; one row per issue.

    nodes is (slug, seq, number, title, body, url, created_at, labels, prs array<struct<number,
    merged, merged_at, merge_sha, repo, files_total, files array<struct<path, change_type>>>>).
    """
    closer = F.get(F.filter("prs", lambda p: p["merged"] & (p["repo"] == F.col("slug"))), F.lit(0))
    hits = nodes.withColumn("closer", closer).where(F.col("closer").isNotNull())
    table = F.create_map(*[F.lit(x) for kv in V.CHANGE_TYPES.items() for x in kv])
    files = F.transform("closer.files", lambda f: F.struct(
        f["path"].alias("filename"), F.coalesce(F.try_element_at(table, f["change_type"]), F.lower(f["change_type"])).alias("status")))
    out = _first_per_issue(hits, limit)
    return out.select("slug", "number", "title", F.coalesce("body", F.lit("")).alias("body"), "url", "labels", "created_at",
                      F.col("closer.number").alias("pr_number"), F.coalesce("closer.merge_sha", F.lit("")).alias("merge_sha"),
                      F.col("closer.merged_at").alias("merged_at"),
                      F.coalesce("closer.files_total", F.size("closer.files")).alias("files_total"), files.alias("files"))


def _first_per_issue(rows: DataFrame, limit: int | None) -> DataFrame:
    first = rows.groupBy("slug", "number").agg(F.min_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
    if limit is None:
        return first
    return top_k(first, limit, ["slug"], [F.col("seq")]).drop("rank")


def nondefects(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Issues without a same-repo merged closer that carry a non-defect label."""
    closed = F.exists("prs", lambda p: p["merged"] & (p["repo"] == F.col("slug")))
    labelled = F.arrays_overlap(F.transform("labels", F.lower), F.array(*[F.lit(x) for x in V.NON_DEFECT_LABELS]))
    return _first_per_issue(nodes.where(~closed & labelled), limit).select("slug", "number", "title", "body", "labels")


def with_owner_tokens(cases: DataFrame) -> DataFrame:
    """Adds tokens and ordered redaction rules; owner columns come from the case row."""
    tokens = X.owner_tokens(F.col("owner_namespaces"), F.col("owner_slugs"), F.col("owner_sonames"), F.col("expected_files"),
                            F.coalesce("fix_patch", F.lit("")), F.coalesce("github_slug", F.lit("")))
    return cases.withColumn("tokens", tokens).withColumn("rules", X.redactions(F.col("tokens")))


def scrubbed(cases: DataFrame, texts: list[str], log_array: str | None = None) -> DataFrame:
    """Redact the named text columns, and the texts of array<struct<kind, text>> logs."""
    out = cases.withColumns({t: X.scrub(F.col(t), F.col("rules")) for t in texts})
    if log_array:
        out = out.withColumn(log_array, F.transform(log_array, lambda g: F.struct(
            g["kind"].alias("kind"), X.scrub(g["text"], F.col("rules")).alias("text"))))
    return out


def _family(name: str, tokens: str = "tokens") -> Column:
    return F.transform(F.filter(tokens, lambda t: t["family"] == name), lambda t: t["token"])


def judged_text(description: Column, log_texts: Column) -> Column:
    return F.concat(description, F.lit("\n"), F.array_join(log_texts, "\n"))


def leak_flags(description: Column, log_texts: Column, owner: Column) -> dict[str, Column]:
    """The eight leak checks on sanitized text; reads the row's `tokens` and `met`, those of them that can match it."""
    text = judged_text(description, log_texts)

    def found(family: str, pattern) -> Column:
        return F.exists(_family(family, "met"), lambda t: F.regexp_like(text, pattern(t)))

    def word_any_case(t: Column) -> Column:
        return F.concat(F.lit("(?i)"), X.word_pattern(t))

    known = F.concat(F.transform(_family("SO"), F.lower), F.array(*[F.lit(s.lower()) for s in V.GENERIC_SONAMES]))
    sos = T.matches(text, r"\blib\w+\.so\b")
    sig = L.signal_tokens(L.signals(F.array_join(log_texts, "\n"), description))
    owned = F.array_union(F.array(owner), F.concat(
        _family("REPO"), _family("PKG"), _family("METHOD"), F.transform(_family("SO"), X.soname_stem)))
    return {
        "reponame_in_text": F.exists(F.array_union(_family("REPO", "met"), F.array(owner)), lambda t: F.regexp_like(text, word_any_case(t))),
        "package_in_text": found("PKG", X.namespace_pattern),
        "file_in_text": found("PATH", X.word_pattern),
        "class_in_text": F.lit(False),
        "so_in_text": found("SO", lambda t: word_any_case(X.soname_stem(t))),
        "patch_in_text": F.exists(_family("PATCH", "met"), lambda t: text.contains(t)),
        "unknown_so_in_text": T.let(known, lambda ks: F.exists(sos, lambda s: ~F.array_contains(ks, F.lower(s)))),
        "extractor_leak": T.let(owned, lambda os: F.exists(sig, lambda t: F.exists(
            os, lambda o: (o == t) | F.replace(t, F.lit("/"), F.lit(".")).contains(o)))),
    }


FLAGS = ["reponame_in_text", "package_in_text", "file_in_text", "class_in_text", "so_in_text", "patch_in_text",
         "unknown_so_in_text", "extractor_leak"]


def with_verdict(cases: DataFrame, description: str, logs: str, owner: str) -> DataFrame:
    """Adds the eight flags and ADMIT / BUCKET_PROSE_ONLY / REJECT.

    A case is bucketed when no error, library or class signal is left in it.
    """
    texts = F.transform(logs, lambda g: g["text"])
    met = X.possible(X.anchored(F.col("tokens")), judged_text(F.col(description), texts))
    out = cases.withColumn("met", met).withColumns(leak_flags(F.col(description), texts, F.col(owner))).drop("met")
    sig = L.signals(F.array_join(texts, "\n"), F.col(description))
    left = F.size(F.concat(sig["errors"], sig["libraries"], sig["classes"])) > 0
    leaks = F.lit(False)
    for f in FLAGS:
        leaks = leaks | F.col(f)
    return out.withColumn("verdict", F.when(leaks, F.lit("REJECT")).when(left, F.lit("ADMIT")).otherwise(F.lit("BUCKET_PROSE_ONLY")))


def owner_still_wins(units: DataFrame, cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """case_ids whose owner still ranks first with a positive score on sanitized text.

    cases is (case_id, owner, description, log_text).
    """
    tokens = faults.case_tokens(faults.extract_signals(cases))
    cands = ranking.candidates(cases, catalog)
    top = ranking.membership(units, tokens, cands).where((F.col("rank") == 1) & (F.col("score") > 0))
    return cases.select("case_id", "owner").join(top.select("case_id", F.col("repo").alias("owner")), ["case_id", "owner"]).select("case_id")


def hold_out(rows: DataFrame, order: list, frac: float) -> DataFrame:
    """Adds held_out: every stride-th row of a fixed order, stride = max(2, round(1/frac))."""
    if frac <= 0 or frac >= 1:
        return rows.withColumn("held_out", F.lit(frac >= 1))
    stride = max(2, round(1 / frac))
    return with_ordinal(rows, order, "seq").withColumn("held_out", F.col("seq") % stride == 0)


def outcomes(cands: DataFrame, holdout_frac: float = 0.0, coverage_cutoff: str = "", max_files: int = 5,
             require_crash_log: bool = False, require_merged_fix: bool = False, leaking: DataFrame | None = None) -> DataFrame:
    """The mining flow as one job: each candidate with its outcome and negative class.

    Order: filters, gate, split, scrub, verdict, closed-loop leak check, class. cands carries the
    owner columns, `owner` and `fix_patch`. leaking is (slug, number) found by owner_still_wins.
    """
    ok = is_minable(F.lit(True), F.col("title"), F.col("files_total"), F.col("files"), max_files) & admit_e2e(
        F.col("body"), F.col("merge_sha"), F.col("files"), require_crash_log, require_merged_fix)
    keyed = cands.withColumns({"id": F.struct("slug", "number"), "expected_files": production_files(F.col("files")), "_ok": ok})
    dropped = keyed.where(~F.col("_ok")).select("slug", "number", F.lit("dropped_filters").alias("outcome"),
                                                F.lit(None).cast("string").alias("negative_class"))
    live = keyed.where("_ok").drop("_ok")
    parts = faults.split_bodies(live.select("id", "body"))
    rows = scrubbed(with_owner_tokens(live.join(parts, "id")), ["prose", "title"], "logs")
    rows = rows.withColumn("described", F.concat("prose", F.lit("\n"), "title"))
    judged = with_verdict(rows, "described", "logs", "owner").select("slug", "number", "merged_at", "verdict")
    if leaking is not None:
        judged = judged.join(leaking.select("slug", "number", F.lit(True).alias("_wins")), ["slug", "number"], "left")
        judged = judged.withColumn("verdict", F.when(F.col("_wins"), F.lit("REJECT")).otherwise(F.col("verdict"))).drop("_wins")
    judged = cut(judged)
    rejected = judged.where("verdict = 'REJECT'").select("slug", "number", F.lit("rejected_leak").alias("outcome"),
                                                         F.lit(None).cast("string").alias("negative_class"))
    bucketed = judged.where("verdict = 'BUCKET_PROSE_ONLY'").select(
        "slug", "number", F.lit("bucketed").alias("outcome"), F.lit("insufficient_signal").alias("negative_class"))
    answerable = hold_out(judged.where("verdict = 'ADMIT'"), [F.col("slug"), F.col("number")], holdout_frac)
    gap = F.lit(bool(coverage_cutoff)) & (F.coalesce("merged_at", F.lit("")) > coverage_cutoff)
    classed = answerable.select(
        "slug", "number",
        F.when(gap, F.lit("coverage_gap")).when(F.col("held_out"), F.lit("oof")).otherwise(F.lit("admitted")).alias("outcome"),
        F.when(gap, F.lit("coverage_gap")).when(F.col("held_out"), F.lit("out_of_fleet")).alias("negative_class"))
    return dropped.unionByName(rejected).unionByName(bucketed).unionByName(classed)


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


def validate_authored(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, problem) rows of hand-written cases checked against real source files(repo, path, text).

    cases is (case_id, ticket_id, summary, description, log_text, owning_repo, expected_files,
    required_apis, fix_diff).
    """
    want = cases.select("case_id", F.col("owning_repo").alias("repo"), F.explode("expected_files").alias("path"))
    found = want.join(files.select("repo", "path", "text"), ["repo", "path"], "left")
    missing = found.where(F.col("text").isNull()).select("case_id", F.concat(
        F.lit("expected_file not found in real source: "), "repo", F.lit("/"), "path").alias("problem"))
    apis = cases.select("case_id", F.explode("required_apis").alias("api"))
    seen = apis.join(found.where(F.col("text").isNotNull()).select("case_id", "text"), "case_id", "left").groupBy("case_id", "api").agg(
        F.coalesce(F.bool_or(F.col("text").contains(F.col("api"))), F.lit(False)).alias("ok"))
    no_api = seen.where(~F.col("ok")).select("case_id", F.concat(F.lit("required_api not found in real source: "), "api").alias("problem"))
    names = F.concat("required_apis", F.transform("expected_files", T.basename))
    grounded = F.exists(names, lambda n: F.coalesce("log_text", F.lit("")).contains(n))
    blob = F.lower(F.concat_ws("\n", "summary", "description", "log_text", "ticket_id"))
    owner = F.col("owning_repo")
    forms = F.array(owner, F.replace(owner, F.lit("-"), F.lit("")), F.replace(owner, F.lit("-"), F.lit("_")))
    leaks = F.exists(forms, lambda v: (v != "") & blob.contains(F.lower(v)))
    heads = F.transform(F.filter(F.split("fix_diff", "\n"), lambda s: s.rlike(r"^(?:\+\+\+|---) .+$")),
                        lambda s: F.regexp_replace(F.trim(s.substr(F.lit(5), F.length(s))), r"\A[ab]/", ""))
    touches = F.exists(heads, lambda p: F.exists("expected_files", lambda e: (
        (T.basename(p) == T.basename(e)) | F.endswith(p, e) | F.endswith(e, p))))
    added, code = F.array_join(X.added_lines(F.col("fix_diff")), "\n"), F.array_join(X.code_added_lines(F.col("fix_diff")), "\n")
    has_apis = F.size("required_apis") > 0
    named = F.exists("required_apis", lambda a: added.contains(a))
    coded = F.exists("required_apis", lambda a: code.contains(a))
    has_diff = F.col("fix_diff").isNotNull()
    local = F.array_compact(F.array(
        F.when(~grounded, F.lit("crash log names no oracle symbol (ungrounded)")),
        F.when(leaks, F.concat(F.lit("owning_repo name leaks into the ticket: "), owner)),
        F.when(has_diff & ~touches, F.lit("fix.diff does not touch any expected_file")),
        F.when(has_diff & has_apis & ~named, F.lit("fix.diff does not reference any required_api on an added line")),
        F.when(has_diff & has_apis & named & ~coded, F.lit("fix.diff references required_api only in comments, not real code"))))
    return missing.unionByName(no_api).unionByName(cases.select("case_id", F.explode(local).alias("problem")))


def identifier_table(files: DataFrame) -> DataFrame:
    """Distinct (repo, ident) over source files(repo, text)."""
    return files.select("repo", F.explode(F.array_distinct(T.matches(F.col("text"), r"[A-Za-z_][A-Za-z0-9_]*"))).alias("ident")).distinct()


def identifiers_exist(idents: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, name, exists) by the last :: segment; an empty name never exists."""
    asked = names.withColumn("ident", F.substring_index("name", "::", -1))
    hit = join_sized(idents, asked.select("repo", "ident").distinct(), ["repo", "ident"]).withColumn("exists", F.lit(True))
    return asked.join(hit, ["repo", "ident"], "left").select(
        "repo", "name", (F.coalesce("exists", F.lit(False)) & (F.col("name") != "")).alias("exists"))
