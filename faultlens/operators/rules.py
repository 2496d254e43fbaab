"""Rule store: declarative predicates, selection, grounding, minting, lint, lifecycle and attribution.

Rules are long rows (rule_id, key, value). Clauses of a rule are OR'd, `all_text` needs every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import diffs as X
from faultlens.functions import logs as L
from faultlens.functions import metrics as M
from faultlens.functions import text as T
from faultlens.operators import lexical, matching
from faultlens.session import cut, join_sized

VALID_KEYS = (["always", "repo_in", "any_text", "all_text", "any_text_regex"] + [f"any_{f}" for f in V.SIGNAL_FAMILIES]
              + [f"any_{f}_regex" for f in V.SIGNAL_FAMILIES])

def contexts(tickets: DataFrame) -> DataFrame:
    """(ctx_id, repo, text, families...) of tickets(case_id, repo, summary, description, log_text, signals)."""
    hay = F.lower(F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("summary", "description", "log_text")]))
    return tickets.select(F.col("case_id").alias("ctx_id"), "repo", hay.alias("text"),
                          *[F.col(f"signals.{f}").alias(f) for f in V.SIGNAL_FAMILIES])


def fired(ctx: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (ctx_id, rule_id) of rules(rule_id, key, value) that hold in a context (ctx_id, repo, text, families...).

    Texts and tokens meet an index of the rules' rarest grams by their words; only what meets is verified, and all of it in the JVM. `all_text`
    needs all of its distinct values: the rarest is looked for, the others where it holds. Values are compared in lower case with texts as they are and tokens in lower case. Unknown keys fail the job.
    """
    bad = F.raise_error(F.concat(F.lit("unknown predicate keys: "), F.col("key")))
    rows = cut(rules.select("rule_id", F.when(F.col("key").isin(VALID_KEYS), F.col("key")).otherwise(bad).alias("key"), F.col("value").cast("string").alias("value")))
    pattern = F.col("key").endswith("_regex")
    field = F.regexp_replace(F.regexp_replace("key", "_regex$", ""), "^(any|all)_", "")
    clauses = rows.where(F.col("key").rlike("^(any|all)_")).select(
        "rule_id", "key", field.alias("field"), F.when(pattern, "pattern").otherwise("literal").alias("kind"),
        F.when(pattern, F.col("value")).otherwise(F.lower("value")).alias("value")).distinct().withColumn("id", matching.identity("field", "kind", "value"))
    ctx = cut(ctx.select("ctx_id", "repo", "text", *V.SIGNAL_FAMILIES).withColumn("row", F.monotonically_increasing_id()))
    none = F.lit(None).cast("array<string>")
    fields = [F.struct(F.lit("text").alias("field"), F.coalesce("text", F.lit("")).alias("hay"), none.alias("toks"))]
    for f in V.SIGNAL_FAMILIES:
        toks = F.transform(f, F.lower)
        fields.append(F.when(F.size(f) > 0, F.struct(F.lit(f).alias("field"), F.array_join(toks, "\0").alias("hay"), toks.alias("toks"))))
    parts = ctx.select("row", F.explode(F.array_compact(F.array(*fields))).alias("f")).select("row", "f.*")
    single, every = clauses.where("key <> 'all_text'"), clauses.where("key = 'all_text'")
    every = every.join(every.where("value IS NULL").select("rule_id"), "rule_id", "left_anti")
    held, proposed = matching.matches_and_groups(parts, single.select("field", "kind", "value"), every.select(F.col("rule_id").alias("group"), "field", "kind", "value"))
    held = held.join(single.select("id", "rule_id"), "id").select("row", "rule_id")
    # where the rarest value of a rule holds, the others are looked up in the text
    opened = proposed.groupBy("row").agg(F.collect_list(F.struct("group", "others")).alias("open"))
    whole = opened.join(parts.where("field = 'text'").select("row", "hay"), "row").select("row", F.explode_outer(F.filter(
        "open", lambda r: F.forall(r["others"], lambda v: F.contains(F.col("hay"), v)))).alias("r")).where("r IS NOT NULL").select("row", F.col("r.group").alias("rule_id"))
    repos = rows.where("key = 'repo_in'").select("rule_id", F.lower("value").alias("name"))
    there = ctx.select("row", F.lower(F.coalesce("repo", F.lit(""))).alias("name")).join(repos, "name")
    always = rows.where("key = 'always' AND value <> 'false'").agg(F.collect_set("rule_id").alias("ids"))
    on = (ctx.select("row", F.pmod("row", F.lit(1)).cast("int").alias("zero")).join(F.broadcast(always.withColumn("zero", F.pmod(F.size("ids"), F.lit(1)))), "zero")
          .select("row", F.explode("ids").alias("rule_id")))  # one row of ids meets all
    hits = held.unionByName(whole).unionByName(there.select("row", "rule_id")).unionByName(on).distinct()
    return ctx.select("row", "ctx_id").join(hits, "row").select("ctx_id", "rule_id")


def tier_rank(c: Column) -> Column:
    """Position on the trust ladder from 0, null off the ladder."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in V.TIERS]), c), F.lit(0)) - 1


def cosine_or_one(a: Column, b: Column) -> Column:
    """Cosine with a zero norm counted as 1."""
    def norm(v: Column) -> Column:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(n == 0, F.lit(1.0)).otherwise(n)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def select_rules(hits: DataFrame, meta: DataFrame, tier_floor: str, k: int = 2, ctx_vecs: DataFrame | None = None) -> DataFrame:
    """First k fired rules per context at or above a tier: store order, or cosine to the rule vector.

    meta is (rule_id, pos, tier[, vec]); ctx_vecs is (ctx_id, vec). Where a context or a rule has no vector, its rules follow the scored ones in store order.
    """
    floor = V.TIERS.index(tier_floor)
    cols = ["rule_id", "pos", "tier"] + (["vec"] if ctx_vecs is not None else [])
    live = join_sized(hits, meta.select(*cols).where(tier_rank(F.col("tier")) >= floor), ["rule_id"])
    if ctx_vecs is None:
        return lexical.top_k(live, k, ["ctx_id"], [F.col("pos")])
    scored = live.withColumnRenamed("vec", "rvec").join(ctx_vecs, "ctx_id", "left").withColumn(
        "score", F.round(cosine_or_one(F.col("vec"), F.col("rvec")), 9)).drop("vec", "rvec")
    return lexical.top_k(scored, k, ["ctx_id"], [F.col("score").desc_nulls_last(), F.when(F.col("score").isNull(), F.col("pos")), F.col("rule_id")])


def resolve_refs(units: DataFrame, refs: DataFrame, k: int = 20) -> DataFrame:
    """(ref, resolved): does one of the best k fleet-wide hits carry the whole identifier?"""
    asked = refs.select(T.strip(F.col("ref")).alias("query")).where(F.col("query") != "").distinct().withColumn("qid", F.col("query"))
    hits = lexical.search(units, asked, k).select("qid", "uid")
    hay = units.select("uid", F.concat_ws(" ", "name", "qualified_name", "text").alias("hay"))
    whole = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), T.quoted(F.col("qid")), F.lit("(?![A-Za-z0-9_])"))
    found = hits.join(hay, "uid").groupBy("qid").agg(F.bool_or(F.regexp_like("hay", whole)).alias("resolved"))
    out = refs.select("ref", T.strip(F.col("ref")).alias("qid")).distinct()
    return out.join(found, "qid", "left").select("ref", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def _haystack() -> Column:
    return F.lower(F.concat_ws("\n", "signature", *[F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in (
        "localize", "fix", "required_apis", "refs")], F.array_join(F.flatten(F.map_values("applies_when")), " ")))


def leaking(items: DataFrame, hay: Column, denylist: DataFrame) -> DataFrame:
    """(id, leak_tokens): denied tokens found anywhere in an item's text; denylist is (token)."""
    none = F.array().cast("array<string>")
    ctx = items.select(F.col("id").alias("ctx_id"), F.lit(None).cast("string").alias("repo"), hay.alias("text"),
                       *[none.alias(f) for f in V.SIGNAL_FAMILIES])
    rules = denylist.select(F.col("token").alias("rule_id"), F.lit("any_text").alias("key"), F.col("token").alias("value"))
    return fired(ctx, rules).groupBy(F.col("ctx_id").alias("id")).agg(F.array_sort(F.collect_set("rule_id")).alias("leak_tokens"))


def check_grounded(items: DataFrame, resolved: DataFrame, denylist: DataFrame) -> DataFrame:
    """(id, grounded, resolved_refs, missing_refs, leak_tokens, reasons) of store items.

    items is (id, signature, localize, fix, required_apis, refs, applies_when map<string,array<string>>);
    resolved is resolve_refs output. Ill-formed, unresolved or leaking items are not grounded.
    """
    refs = items.select("id", F.posexplode("refs").alias("pos", "ref"))
    seen = join_sized(refs, cut(resolved), ["ref"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    per = seen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "resolved"))).alias("r"))
    rows = items.join(per, "id", "left").join(leaking(items, _haystack(), denylist), "id", "left")
    none = F.array().cast("array<string>")

    def pick(ok: bool) -> Column:
        return F.coalesce(F.transform(F.filter("r", lambda x: x["resolved"] if ok else ~x["resolved"]), lambda x: x["ref"]), none)

    rows = rows.withColumns({"resolved_refs": pick(True), "missing_refs": pick(False), "leak_tokens": F.coalesce("leak_tokens", none)})
    bad_keys = F.array_sort(F.array_except(F.map_keys("applies_when"), F.array(*[F.lit(k) for k in VALID_KEYS])))
    empty = F.coalesce(F.size(F.map_keys("applies_when")), F.lit(0)) <= 0
    reasons = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("signature", F.lit(""))) == "", F.lit("empty_signature")),
        F.when(F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) == "", F.lit("empty_id")),
        F.when(empty, F.lit("empty_predicate")),
        F.when(~empty & (F.size(bad_keys) > 0), F.concat(F.lit("bad_predicate:"), F.array_join(bad_keys, ","))),
        F.when(F.size("refs") == 0, F.lit("no_grounding_refs")),
        F.when(F.size("missing_refs") > 0, F.concat(F.lit("unresolved_refs:"), F.array_join("missing_refs", ","))),
        F.when(F.size("leak_tokens") > 0, F.concat(F.lit("leak:"), F.array_join("leak_tokens", ",")))))
    return rows.withColumn("reasons", reasons).select(
        "id", (F.size("reasons") == 0).alias("grounded"), "resolved_refs", "missing_refs", "leak_tokens", "reasons")


def clause(guidance: Column, label: str) -> Column:
    """Text of the first 'Label: ...' line, '' without one."""
    return T.strip(F.regexp_extract(guidance, rf"(?m)^[^\S\n]*{label}([^\n]*)$", 1))


def seed_items(skills: DataFrame) -> DataFrame:
    """Store items of raw skills(id, guidance, hint_apis, applies_when): clauses lifted, tier candidate."""
    apis = F.transform(F.filter("hint_apis", lambda a: T.strip(a) != ""), lambda x: T.strip(x))
    loc, fix = clause(F.col("guidance"), "Localize:"), clause(F.col("guidance"), "Fix:")
    none = F.array().cast("array<string>")
    return skills.select(
        "id", "applies_when", clause(F.col("guidance"), "Signature:").alias("signature"),
        F.when(loc != "", F.array(loc)).otherwise(none).alias("localize"), F.when(fix != "", F.array(fix)).otherwise(none).alias("fix"),
        apis.alias("required_apis"), apis.alias("refs"), F.col("id").cast("string").alias("provenance"), F.lit("candidate").alias("tier"))


def merge_items(items: DataFrame, checks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Existing items plus the grounded new ones; an existing id is never overwritten."""
    good = items.join(checks.where("grounded").select("id"), "id", "left_semi")
    if existing is None:
        return good
    return existing.unionByName(good.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def mint_items(fixes: DataFrame) -> DataFrame:
    """Candidate items of clean fixes(case_id, signals, locations, patch_diff); equal crash classes share an id.

    Refs are the identifiers and identifier segments of added lines that the signals also name.
    """
    order = ["errors", "classes", "methods", "symbols", "libraries", "packages"]
    toks = F.concat(*[F.col(f"signals.{f}") for f in order])
    key = F.array_join(F.array_sort(F.array_distinct(toks)), "|")
    idents = T.matches(F.array_join(X.added_lines(F.col("patch_diff")), "\n"), r"[A-Za-z_][A-Za-z0-9_.:]{2,}")
    segments = F.flatten(F.transform(idents, lambda t: F.split(t, r"[.:]+")))
    vocab = F.concat(*[F.col(f"signals.{f}") for f in ("methods", "symbols", "classes", "libraries")])
    refs = F.array_sort(F.array_intersect(T.distinct_tokens(idents, segments), vocab))
    rows = fixes.withColumns({"toks": toks, "refs": refs})
    none = F.array().cast("array<string>")
    has = F.size("toks") > 0
    return rows.select(
        F.concat(F.lit("minted-"), F.substring(F.sha1(key), 1, 10)).alias("id"),
        F.when(has, F.create_map(F.lit("any_text"), F.transform("toks", F.lower))).otherwise(
            F.create_map().cast("map<string,array<string>>")).alias("applies_when"),
        F.when(has, F.array_join("toks", " ")).otherwise(F.lit("(unlabelled crash)")).alias("signature"),
        F.col("locations").alias("localize"),
        F.when(F.size("refs") > 0, F.array(F.concat(F.lit("touched: "), F.array_join("refs", ", ")))).otherwise(none).alias("fix"),
        F.col("refs").alias("required_apis"), "refs", F.concat(F.lit("minted:"), F.col("case_id").cast("string")).alias("provenance"),
        F.lit("candidate").alias("tier"))


def first_minted(items: DataFrame) -> DataFrame:
    """One item per id, the least provenance."""
    return items.groupBy("id").agg(F.min_by(F.struct(*[c for c in items.columns if c != "id"]), "provenance").alias("r")).select("id", "r.*")


def mint_grounded(fixes: DataFrame, units: DataFrame, denylist: DataFrame) -> DataFrame:
    """Minted items of fixes whose refs all resolve among units and whose text names no denied token, one per id.

    Each fix is judged by itself, so an id is kept if any of its fixes is grounded; a fix that touched nothing the signals name has no refs and mints
    nothing. Repeated fixes of a case count once.
    """
    items = cut(mint_items(fixes).dropDuplicates(["provenance"]))
    resolved = resolve_refs(units, items.select(F.explode("refs").alias("ref")).distinct())
    good = check_grounded(items.withColumn("id", F.col("provenance")), resolved, denylist).where("grounded")
    return first_minted(items.join(good.select(F.col("id").alias("provenance")), "provenance", "left_semi"))


def lint(skills: DataFrame, denylist: DataFrame) -> DataFrame:
    """(id, issue) rows: ids, provenance, clauses, predicate keys, and denied tokens in any text.

    skills is (id, provenance, guidance, signals, hint_apis, match map<string,array<string>>).
    """
    sid = F.coalesce(F.nullif("id", F.lit("")), F.lit("<no-id>"))
    rows = skills.withColumn("sid", sid)
    keys = F.map_keys("match")
    empty = F.coalesce(F.size(keys), F.lit(0)) <= 0
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in VALID_KEYS]))
    banned = F.array_intersect(keys, F.array(F.lit("always"), F.lit("repo_in")))
    flat = F.concat(
        F.array_compact(F.array(
            F.when(F.coalesce("id", F.lit("")) == "", F.lit("missing id")),
            F.when(F.coalesce("provenance", F.lit("")) == "", F.lit("missing provenance")),
            *[F.when(~F.coalesce("guidance", F.lit("")).contains(c), F.lit(f"guidance missing '{c}' clause")) for c in V.RULE_CLAUSES],
            F.when(empty, F.lit("empty match (would never fire)")))),
        F.transform(F.coalesce(unknown, F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown match key '"), k, F.lit("'"))),
        F.transform(F.coalesce(banned, F.array().cast("array<string>")), lambda k: F.concat(F.lit("forbidden match key '"), k, F.lit("'"))))
    local = rows.select(F.col("sid").alias("id"), F.explode(flat).alias("issue"))
    twice = rows.groupBy(F.col("sid").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(
        "id", F.explode(F.array_repeat(F.lit("duplicate id"), (F.col("n") - 1).cast("int"))).alias("issue"))
    none = F.array().cast("array<string>")
    hay = F.lower(F.concat_ws("\n", "guidance", F.array_join(F.coalesce("signals", none), " "), F.array_join(F.coalesce("hint_apis", none), " "),
                              F.array_join(F.coalesce(F.flatten(F.map_values("match")), none), " ")))
    leaks = leaking(rows.withColumn("id", F.col("sid")), hay, denylist).select("id", F.explode("leak_tokens").alias("t")).select(
        "id", F.concat(F.lit("LEAK: owner token '"), "t", F.lit("' present")).alias("issue"))
    return local.unionByName(twice).unionByName(leaks)


def owner_denylist(owners: DataFrame) -> DataFrame:
    """Distinct lowered (token) of owners(repo, namespaces, slugs, sonames)."""
    return owners.select(F.explode(F.concat(F.array("repo"), "namespaces", "slugs", "sonames")).alias("t")).where(
        F.coalesce("t", F.lit("")) != "").select(F.lower("t").alias("token")).distinct()


def missing_owners(fleet: DataFrame, owners: DataFrame) -> DataFrame:
    return fleet.select("repo").distinct().join(owners.select("repo"), "repo", "left_anti")


def placebos(items: DataFrame) -> DataFrame:
    """One placebo per item: same predicate and tier, filler text of the same length, no refs."""
    def filler(ref: Column) -> Column:
        n = F.greatest(F.length(F.coalesce(ref, F.lit(""))), F.lit(40))
        return F.substring(F.repeat(F.lit(V.PLACEBO_FILLER), (n / len(V.PLACEBO_FILLER)).cast("int") + 1), F.lit(1), n)

    none = F.array().cast("array<string>")
    return items.select(
        F.concat(F.lit("placebo-"), F.col("id").cast("string")).alias("id"), "applies_when", filler(F.col("signature")).alias("signature"),
        F.when(F.size("localize") > 0, F.array(filler(F.array_join("localize", " ")))).otherwise(none).alias("localize"),
        F.array(filler(F.array_join("fix", " "))).alias("fix"), none.alias("required_apis"), none.alias("refs"),
        F.concat(F.lit("placebo control paired to knowledge "), F.col("id").cast("string"),
                 F.lit(" (length-matched, irrelevant content)")).alias("provenance"), "tier")


# --- lifecycle ---------------------------------------------------------------------------------------

STATE = "struct<tier:int,streak:int,demotions:array<string>>"
RETIRED = -1


def _step(s: Column, passed: Column, hysteresis: int, retire: bool) -> Column:
    """One verdict on (tier index, streak, demotions)."""
    names = F.array(*[F.lit(t) for t in V.TIERS])
    top = len(V.TIERS) - 1
    tier, streak = s["tier"], s["streak"]
    trip = ~passed & (streak + 1 >= hysteresis)
    floor = F.when(tier == 0, F.lit(RETIRED if retire else 0)).otherwise(tier - 1)
    to_name = F.when(floor == RETIRED, F.lit("retired")).otherwise(F.get(names, floor))
    move = F.concat(F.get(names, tier), F.lit("->"), to_name)
    live = F.struct(
        F.when(passed, F.least(tier + 1, F.lit(top))).when(trip, floor).otherwise(tier).cast("int").alias("tier"),
        F.when(passed | trip, F.lit(0)).otherwise(streak + 1).cast("int").alias("streak"),
        F.when(trip, F.concat(s["demotions"], F.array(move))).otherwise(s["demotions"]).alias("demotions"))
    return F.when(tier < 0, s).otherwise(live)


def fold_verdicts(verdicts: DataFrame, hysteresis: int = 2, retire: bool = False, chunk: int = 10_000) -> DataFrame:
    """(item, tier, streak, demotions) after an item's ordered verdicts, starting as candidate.

    verdicts is (item, seq, passed) with seq unique per item. A history is cut into chunks of `chunk`
    sequence numbers; each chunk is folded on its own from every possible start state, then the chunk
    results are chained, so no task ever holds a whole long history.
    """
    states = [(t, k) for t in range(len(V.TIERS)) for k in range(hysteresis)]
    cells = verdicts.groupBy("item", F.floor(F.col("seq") / chunk).alias("c")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "passed"))), lambda x: x["passed"]).alias("vs"))
    starts = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in states])
    begin = F.struct(F.col("s.t").cast("int").alias("tier"), F.col("s.k").cast("int").alias("streak"),
                     F.array().cast("array<string>").alias("demotions"))
    ends = cells.select("item", "c", "vs", F.explode(starts).alias("s")).select(
        "item", "c", (F.col("s.t") * hysteresis + F.col("s.k")).alias("from"),
        F.aggregate("vs", begin, lambda acc, v: _step(acc, v, hysteresis, retire)).alias("end"))
    moves = ends.groupBy("item", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("from", "end"))), lambda x: x["end"]).alias("ends"))
    chain = moves.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "ends"))), lambda x: x["ends"]).alias("chain"))
    zero = F.struct(F.lit(0).alias("tier"), F.lit(0).alias("streak"), F.array().cast("array<string>").alias("demotions"))

    def hop(acc: Column, ends_of: Column) -> Column:
        nxt = F.get(ends_of, acc["tier"] * hysteresis + acc["streak"])
        return F.when(acc["tier"] < 0, acc).otherwise(F.struct(
            nxt["tier"].alias("tier"), nxt["streak"].alias("streak"), F.concat(acc["demotions"], nxt["demotions"]).alias("demotions")))

    out = chain.select("item", F.aggregate("chain", zero, hop).alias("s"))
    return out.select("item", tier_name(F.col("s.tier")).alias("tier"), F.col("s.streak").alias("fail_count"), F.col("s.demotions").alias("demotions"))


def tier_name(index: Column) -> Column:
    return F.when(index < 0, F.lit("retired")).otherwise(F.get(F.array(*[F.lit(t) for t in V.TIERS]), index))


EVIDENCE = ("measured_lift", "wilson95")


def promote_or_retire(items: DataFrame, hysteresis: int = 2, evidence: DataFrame | None = None) -> DataFrame:
    """Apply one verdict (column passed) to items(id, tier, fail_count, demotions); off-ladder items stay.

    evidence is (id, measured_lift, wilson95), one row per id: what is not null there replaces what an item on the ladder had of it.
    """
    if evidence is not None:
        items = items.join(evidence.select("id", *[F.col(c).alias(f"_{c}") for c in EVIDENCE]), "id", "left")
    at = F.coalesce(tier_rank(F.col("tier")), F.lit(RETIRED)).cast("int")
    state = F.struct(at.alias("tier"), F.col("fail_count").cast("int").alias("streak"), F.col("demotions").alias("demotions"))
    rows = items.withColumn("_s", T.let(state, lambda s: _step(s, F.col("passed"), hysteresis, True)))
    moved = at >= 0
    new = {
        "tier": F.when(moved, tier_name(F.col("_s.tier"))).otherwise(F.col("tier")),
        "fail_count": F.when(moved, F.col("_s.streak")).otherwise(F.col("fail_count").cast("int")),
        "demotions": F.when(moved, F.col("_s.demotions")).otherwise(F.col("demotions"))}
    for c in EVIDENCE if evidence is not None else ():
        given = F.when(moved, F.col(f"_{c}"))
        new[c] = F.coalesce(given, c) if c in items.columns else given
    return rows.withColumns(new).drop("_s", *[f"_{c}" for c in EVIDENCE])


def lift_evidence(archive: DataFrame, items: DataFrame) -> DataFrame:
    """(id, measured_lift, wilson95 struct<low, high>) of ladder items that fired: lift over the other cases, and the interval of patches that apply.

    archive is (case_id, fired array, groundedness, patch_applies); cases without groundedness do not count. The lift is null where all cases fired.
    """
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    live = items.where(tier_rank(F.col("tier")).isNotNull()).select("id").distinct()
    per = _fired_cases(archive).groupBy("id").agg(F.count_if(F.coalesce("patch_applies", F.lit(False))).alias("k"), F.count("*").alias("n"))
    rates = per.join(live, "id", "left_semi").select("id", F.struct(lo.alias("low"), hi.alias("high")).alias("wilson95"))
    return rates.join(screen_lift(archive, items).withColumnRenamed("lift", "measured_lift"), "id", "left").select("id", *EVIDENCE)


def validating_cases(archive: DataFrame, items: DataFrame) -> DataFrame:
    """(id, case_id): cases whose patch applied with a ladder item fired, as rows, since an item may have any number of them."""
    live = items.where(tier_rank(F.col("tier")).isNotNull()).select("id").distinct()
    return _fired_cases(archive).where("patch_applies").join(live, "id", "left_semi").select("id", "case_id").distinct()


def _fired_cases(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("groundedness").isNotNull()).select(F.explode(F.array_distinct("fired")).alias("id"), "case_id", "patch_applies")


# --- attribution -------------------------------------------------------------------------------------

def screen_lift(archive: DataFrame, items: DataFrame, threshold: float = 0.0, min_fired: int = 1) -> DataFrame:
    """(id, lift): mean signal of cases an item fired in minus the mean of the others.

    archive is (case_id, fired array, groundedness, patch_applies). The others come from the grand
    total minus the fired part, so items never meet cases.
    """
    sig = 0.5 * F.col("groundedness") + F.when(F.coalesce("patch_applies", F.lit(False)), 0.5).otherwise(0.0)
    rows = archive.where(F.col("groundedness").isNotNull()).withColumn("sig", sig)
    total = rows.agg(F.sum("sig").alias("ts"), F.count("*").alias("tn"), F.lit(1).alias("one"))
    hit = rows.select(F.explode(F.array_distinct("fired")).alias("id"), "sig").groupBy("id").agg(F.sum("sig").alias("fs"), F.count("*").alias("fn"))
    live = items.where(tier_rank(F.col("tier")).isNotNull()).select("id")
    both = live.join(hit, "id").withColumn("one", F.lit(1)).join(F.broadcast(total), "one").where(
        (F.col("fn") >= max(min_fired, 1)) & (F.col("tn") > F.col("fn")))
    lift = F.col("fs") / F.col("fn") - (F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))
    kept = both.select("id", F.round(lift, 9).alias("lift")).where(F.abs("lift") >= threshold)
    return kept


def leave_one_out(scored_sets: DataFrame) -> DataFrame:
    """(id, delta) of scored_sets(ids array, score): score of the largest set minus the set without id."""
    rows = scored_sets.select(F.array_sort(F.array_distinct("ids")).alias("ids"), "score")
    keyed = rows.withColumn("key", F.array_join("ids", "\u0000"))
    full = rows.agg(F.max_by(F.struct("ids", "score"), F.size("ids")).alias("f")).select("f.*")
    wanted = full.select(F.col("score").alias("base"), "ids", F.explode("ids").alias("id"))
    wanted = wanted.withColumn("key", F.array_join(F.array_except("ids", F.array("id")), "\u0000"))
    return wanted.join(keyed.select("key", "score"), "key").select("id", (F.col("base") - F.col("score")).alias("delta"))


def govern(items: DataFrame, deltas: DataFrame, verdicts: DataFrame, hysteresis: int = 2) -> DataFrame:
    """Promote shortlisted items that are load-bearing and accepted against their placebo, else record a
    failing verdict; other items pass through. deltas is (id, delta), verdicts is (id, accepted)."""
    judged = deltas.join(verdicts, "id").select("id", (F.col("accepted") & (F.col("delta") > 0)).alias("passed"), "delta")
    rows = items.join(judged, "id", "left")
    moved = promote_or_retire(rows.where(F.col("passed").isNotNull()), hysteresis)
    return moved.unionByName(rows.where(F.col("passed").isNull())).drop("passed")


# --- text blocks -------------------------------------------------------------------------------------

def render_items(selected: DataFrame) -> DataFrame:
    """(ctx_id, text) of selected items(ctx_id, rank, id, signature, localize, fix, required_apis)."""
    def line(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), T.squeeze(c))
    block = F.concat_ws("\n", F.concat(F.lit("# Crash playbook: "), F.col("id").cast("string")), line("Signature", F.col("signature")),
                        line("Look at", F.array_join("localize", "; ")), line("Fix", F.array_join("fix", "; ")),
                        line("APIs", F.array_join("required_apis", "; ")))
    return _blocks(selected, block, "\n\n# Grounded playbooks\n")


def render_skills(selected: DataFrame) -> DataFrame:
    """(ctx_id, text) of selected skills(ctx_id, rank, id, guidance)."""
    block = F.concat(F.lit("## Skill: "), F.col("id").cast("string"), F.lit("\n"), "guidance")
    return _blocks(selected, block, "\n\n# Applicable playbooks\n")


def _blocks(selected: DataFrame, block: Column, head: str) -> DataFrame:
    rows = selected.select("ctx_id", "rank", block.alias("block")).groupBy("ctx_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return rows.select("ctx_id", F.concat(F.lit(head), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("text"))


def skill_query(signals: Column, guidance: Column) -> Column:
    """Localize-bias text of one skill: its tags, then the text of its Localize lines."""
    hints = F.transform(T.groups(guidance, r"(?im)^[^\S\n]*localize:([^\n]*)$"), lambda x: T.strip(x))
    return F.array_join(T.non_empty(F.concat(signals, hints)), " ")
