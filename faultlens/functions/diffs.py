"""Unified-diff, leak-token and repair-plan expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import text as T

PATCH_FENCE = r"(?s)```[^\n]*\n(.*?)\n```"
DIFF_START = r"(?m)^(?:diff --git |--- )"
CALL_NAME = r"\b([A-Za-z_$][\w$]*)\s*\("


def _lines(diff: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(diff, F.lit("")), r"\r\n?", "\n"), "\n")


def unified_diff(c: Column) -> Column:
    """First diff-shaped fence of a reply, else the text from the first diff header, else ''."""
    text = F.coalesce(c, F.lit(""))
    fenced = F.get(F.filter(T.groups(text, PATCH_FENCE), lambda b: b.rlike(DIFF_START)), F.lit(0))
    at = F.regexp_instr(text, F.lit(DIFF_START))
    bare = F.when(at > 0, text.substr(at, F.length(text))).otherwise(F.lit(""))
    return F.regexp_replace(F.coalesce(fenced, bare), r"\A\n+|\n+\z", "")


def touched_files(diff: Column) -> Column:
    heads = F.filter(_lines(diff), lambda s: s.startswith("+++ "))
    paths = F.transform(heads, lambda s: T.norm_path(F.substring_index(s.substr(F.lit(5), F.length(s)), "\t", 1)))
    return T.distinct_tokens(paths)


def added_lines(diff: Column) -> Column:
    plus = F.filter(_lines(diff), lambda s: s.startswith("+") & ~s.startswith("+++"))
    return F.transform(plus, lambda s: s.substr(F.lit(2), F.length(s)))


def code_lines(added: Column) -> Column:
    """Lines that are neither blank nor whole-line comments."""
    return F.filter(added, lambda s: ~T.strip(s).rlike(r"\A(?:\z|//|#|\*|/\*)"))


def code_added_lines(diff: Column) -> Column:
    return code_lines(added_lines(diff))


def _names(lines: Column, api: Column) -> Column:
    word = F.concat(F.lit(r"(?U)\b"), T.quoted(api), F.lit(r"\b"))
    return F.exists(lines, lambda s: F.regexp_like(s, word))


def references_api(diff: Column, api: Column) -> Column:
    return _names(added_lines(diff), api)


def references_api_code(diff: Column, api: Column) -> Column:
    return _names(code_added_lines(diff), api)


def references_all(lines: Column, apis: Column) -> Column:
    """Whether every name is a whole word of some line. Lines are cut into words once; only names with other signs need a pattern each."""
    words = T.let(lines, lambda ls: F.struct(ls.alias("lines"), F.array_distinct(F.flatten(F.transform(ls, lambda s: F.split(s, r"(?U)\W+")))).alias("words")))
    return T.let(words, lambda x: F.forall(apis, lambda a: F.when(a.rlike(r"\A[A-Za-z0-9_]+\z"), F.array_contains(x["words"], a)).otherwise(_names(x["lines"], a))))


def required_apis(diff: Column, cap: int | None = None) -> Column:
    """Call-like names (the first `cap`) on added code lines that are no keyword or short word."""
    names = F.flatten(F.transform(code_added_lines(diff), lambda s: T.groups(s, CALL_NAME)))
    kept = F.filter(names, lambda n: (F.length(n) >= 3) & ~F.lower(n).isin(*V.API_STOPWORDS))
    names = F.array_distinct(kept)
    return names if cap is None else F.slice(names, 1, cap)


def assemble_diff(files: Column) -> Column:
    """Header-complete unified diff from array<struct<filename, previous_filename, status, patch>>."""
    with_text = F.filter(files, lambda f: F.coalesce(f["patch"], F.lit("")) != "")

    def one(f: Column) -> Column:
        old = F.coalesce(f["previous_filename"], f["filename"])
        return F.concat_ws(
            "\n",
            F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), f["filename"]),
            F.when(f["status"] == "added", F.lit("--- /dev/null")).otherwise(F.concat(F.lit("--- a/"), old)),
            F.when(f["status"] == "removed", F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/"), f["filename"])),
            F.regexp_replace(f["patch"], r"\n+\z", ""))

    joined = F.array_join(F.transform(with_text, one), "\n")
    return F.when(joined != "", F.concat(joined, F.lit("\n"))).otherwise(F.lit(""))


def patch_added(patch: Column) -> Column:
    """Added lines of a patch; a line holding only the plus sign counts as an empty line."""
    plus = F.filter(_lines(patch), lambda s: s.rlike(r"\A\+(?!\+\+)"))
    return F.transform(plus, lambda s: s.substr(F.lit(2), F.length(s)))


def patch_methods(patch: Column) -> Column:
    return T.distinct_tokens(F.flatten(F.transform(patch_added(patch), lambda s: T.groups(s, CALL_NAME))))


def patch_symbols(patch: Column) -> Column:
    return T.distinct_tokens(F.flatten(F.transform(patch_added(patch), lambda s: T.matches(s, r"[A-Za-z_$][\w$]*"))))


def shingles(patch: Column, least: int = V.MIN_SHINGLE) -> Column:
    """Distinct runs of one to three added lines, squeezed, of at least `least` characters."""
    lines = F.filter(F.transform(patch_added(patch), T.squeeze),
                     lambda s: (s != "") & ~s.isin(*V.SHINGLE_SKIP) & ~s.startswith("import "))

    def runs(ls: Column) -> Column:
        def of(k: int) -> Column:
            starts = F.when(F.size(ls) >= k, F.sequence(F.lit(1), F.size(ls) - (k - 1))).otherwise(
                F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(ls, i, k), " "))

        return F.filter(F.array_distinct(F.concat(of(1), of(2), of(3))), lambda s: F.length(s) >= least)

    return T.let(lines, runs)


def owner_tokens(namespaces: Column, slugs: Column, sonames: Column, files: Column, patch: Column,
                 github_slug: Column) -> Column:
    """Owner-identifying tokens as array<struct<family, token>>: REPO PKG PATH METHOD SO PATCH."""
    org = F.substring_index(github_slug, "/", 1)
    orgs = F.when(github_slug.contains("/") & (org != "") & ~F.lower(org).isin(*V.GENERIC_ORGS), F.array(org)).otherwise(
        F.array().cast("array<string>"))
    stems = F.transform(files, lambda f: F.regexp_replace(T.basename(f), r"\.[^.]*\z", ""))
    by_family = {
        "REPO": F.array_union(slugs, orgs), "PKG": namespaces, "PATH": F.array_union(files, stems),
        "METHOD": F.array_union(patch_methods(patch), patch_symbols(patch)),
        "SO": F.filter(sonames, lambda s: ~s.isin(*V.GENERIC_SONAMES)), "PATCH": shingles(patch),
    }

    def tagged(family: str, tokens: Column) -> Column:
        return F.transform(F.array_distinct(T.non_empty(tokens)),
                           lambda t: F.struct(F.lit(family).alias("family"), t.alias("token")))

    return F.concat(*[tagged(n, v) for n, v in by_family.items()])


NAME_TAIL = r"(?:[./][A-Za-z_$][\w$]*)*"


def namespace_pattern(ns: Column) -> Column:
    """Dotted and slashed spelling of a namespace with any tail."""
    slashed = T.quoted(F.replace(ns, F.lit("."), F.lit("/")))
    return F.concat(F.lit(r"\bL?(?:"), T.quoted(ns), F.lit("|"), slashed, F.lit(f"){NAME_TAIL};?"))


def word_pattern(token: Column) -> Column:
    return F.concat(F.lit(r"\b"), T.quoted(token), F.lit(r"\b"))


def soname_stem(so: Column) -> Column:
    return F.regexp_replace(so, r"\.so\z", "")


SOURCE_SUFFIX = r"\([A-Za-z_$][\w$]*\.(?:java|kt|kts|scala|cpp|cc|cxx|c|h|hpp|mm|so):\d+\)"
WORD = "[A-Za-z0-9_]+"
INNER_WORD = r"(?<=[^A-Za-z0-9_<>])[A-Za-z0-9_]+(?=[^A-Za-z0-9_<>])"
MASKS = {f: f"<REDACTED_{f}>" for f in ("PKG", "SRC", "SO", "PATH", "METHOD", "REPO", "PATCH")}


def anchored(tokens: Column) -> Column:
    """Adds to array<struct<family, token>> a word, in lower case, that any text holds whole wherever the token's pattern matches it.

    Patterns of namespaces and patch lines may begin or end inside a word, so only words inside such a token count;
    null where a token has none. Words next to an angle bracket are left out there, since a mask may border on a cut word.
    """
    def longest(c: Column, pattern: str) -> Column:
        return F.array_max(F.transform(T.matches(c, pattern), lambda w: F.struct(F.length(w).alias("n"), F.lower(w).alias("word"))))["word"]

    def anchor(t: Column) -> Column:
        name = t["token"]
        return F.when(t["family"].isin("PKG", "PATCH"), longest(name, INNER_WORD)).when(
            t["family"] == "SO", longest(soname_stem(name), WORD)).otherwise(longest(name, WORD))

    return F.transform(tokens, lambda t: F.struct(t["family"].alias("family"), t["token"].alias("token"), anchor(t).alias("anchor")))


def possible(entries: Column, text: Column) -> Column:
    """The entries, in order, that can match a text: their `anchor` is null, one of its words, or a word of a mask.

    One hash intersection of all anchors with the distinct words, however many entries there are.
    """
    masks = F.array(*[F.lit(m.strip("<>").lower()) for m in MASKS.values()])
    words = F.concat(F.transform(T.matches(text, WORD), F.lower), masks)
    met = F.array_intersect(F.transform(entries, lambda e: e["anchor"]), words)
    return T.let(met, lambda ws: F.filter(entries, lambda e: e["anchor"].isNull() | F.array_contains(ws, e["anchor"])))


def redactions(tokens: Column) -> Column:
    """Ordered array<struct<step, pattern, mask, anchor>>: family order, then longest token first, then the token.

    Generic identifiers and short lower-case words of the METHOD family are kept. The source suffix
    of stack frames is masked right after the namespaces.
    """
    def wanted(t: Column) -> Column:
        name = t["token"]
        specific = (F.length(name) >= 4) & ~name.isin(*V.GENERIC_IDENTIFIERS) & (
            (name != F.lower(name)) | (F.length(name) >= 8))
        return (t["family"] != "METHOD") | specific

    order = {"PKG": 0, "SO": 2, "PATH": 3, "METHOD": 5, "REPO": 6, "PATCH": 7}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])

    def rule(t: Column) -> Column:
        name = t["token"]
        pattern = (F.when(t["family"] == "PKG", namespace_pattern(name))
                   .when(t["family"] == "SO", F.concat(F.lit("(?i)"), word_pattern(name), F.lit("|"),
                                                       word_pattern(soname_stem(name))))
                   .when(t["family"] == "REPO", F.concat(F.lit("(?i)"), word_pattern(name)))
                   .when(t["family"] == "PATCH", T.quoted(name))
                   .otherwise(word_pattern(name)))
        return F.struct(rank[t["family"]].alias("step"), (-F.length(name)).alias("size"), name.alias("token"),
                        pattern.alias("pattern"), F.concat(F.lit("<REDACTED_"), t["family"], F.lit(">")).alias("mask"), t["anchor"].alias("anchor"))

    suffix = F.array(F.struct(F.lit(1).alias("step"), F.lit(0).alias("size"), F.lit("").alias("token"), F.lit(SOURCE_SUFFIX).alias("pattern"),
                              F.lit(f"({MASKS['SRC']})").alias("mask"), F.lit(None).cast("string").alias("anchor")))
    ordered = F.array_sort(F.concat(F.transform(anchored(F.filter(tokens, wanted)), rule), suffix))
    return F.transform(ordered, lambda r: F.struct(*[r[n].alias(n) for n in ("step", "pattern", "mask", "anchor")]))


def scrub(c: Column, rules: Column) -> Column:
    """Apply ordered redactions to a text; null counts as ''.

    Rules that cannot match are left out beforehand by their anchors, so a text is rewritten once for each token it holds, not
    for each token of its case. Namespaces may leave the rest of a word behind, so words are taken again after them; later
    families replace whole words only, and patch lines come last.
    """
    def rewrite(text: Column, wanted) -> Column:
        return T.let(text, lambda t: F.aggregate(possible(F.filter(rules, wanted), t), t,
                                                 lambda acc, r: F.regexp_replace(acc, r["pattern"], r["mask"])))

    return rewrite(rewrite(F.coalesce(c, F.lit("")), lambda r: r["step"] == 0), lambda r: r["step"] > 0)


PLAN = ("struct<root_cause:string,targets:array<struct<file:string,symbol:string,why:string>>,"
        "required_apis:array<string>,strategy:string,citations:array<string>,risks:string,"
        "confidence:double,abstain:boolean>")


def plan_text(c: Column) -> Column:
    """The JSON span of a plan reply, '' when there is none."""
    text = F.coalesce(c, F.lit(""))
    fence = r"(?s)```(?:json)?\s*\n(.*?)\n```"
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(bare)


def parse_plan(c: Column) -> Column:
    """Tolerant plan struct: bad JSON gives null, list members that are bare strings become targets.

    The reply is decoded once into field texts, so one malformed field cannot void the others.
    """
    none = F.array().cast("array<string>")

    def build(m: Column) -> Column:
        def strings(name: str) -> Column:
            return F.coalesce(T.non_empty(F.from_json(m[name], "array<string>")), none)

        def words(name: str) -> Column:
            return T.strip(F.coalesce(m[name], F.lit("")))

        return F.when(m.isNotNull(), F.struct(
            words("root_cause").alias("root_cause"),
            F.filter(F.transform(strings("targets"), _plan_target), lambda t: F.coalesce(t["file"], F.lit("")) != "").alias("targets"),
            strings("required_apis").alias("required_apis"), words("strategy").alias("strategy"), strings("citations").alias("citations"),
            words("risks").alias("risks"), F.coalesce(m["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
            F.coalesce(m["abstain"] == "true", F.lit(False)).alias("abstain")))

    fields = T.let(plan_text(c), lambda raw: F.when(raw.rlike(r"\A\s*\{"), F.from_json(raw, "map<string,string>")))
    return T.let(fields, build)


def _plan_target(t: Column) -> Column:
    """A target object or bare path as struct<file, symbol, why>."""
    def pick(m: Column) -> Column:
        return F.struct(F.when(m.isNotNull(), m["file"]).otherwise(T.strip(t)).alias("file"), F.nullif(m["symbol"], F.lit("")).alias("symbol"),
                        F.coalesce(m["why"], F.lit("")).alias("why"))

    return T.let(F.when(t.rlike(r"\A\s*\{"), F.from_json(t, "map<string,string>")), pick)
