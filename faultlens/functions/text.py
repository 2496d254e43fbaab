"""Text, identifier, path and hashing expressions. Every function takes and returns a Column."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import fixed_values as V


def _fold_map() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from Unicode decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _fold_map()
WORD = r"[\p{L}\p{N}]+"
SUBWORD = r"[A-Z]+(?=[A-Z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+"
MIXED = r"[a-z][A-Z]|[A-Z]{2}[a-z]|[0-9][A-Za-z]|[A-Za-z][0-9]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate a value once and use it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(c: Column, pattern: str) -> Column:
    """All whole matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def quoted(c: Column) -> Column:
    r"""A column's text as a regex literal: every non-word character is escaped."""
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def in_list(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def has_any(c: Column, needles: list[str]) -> Column:
    """Substring test against a short fixed list."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def starts_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def ends_any(c: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | c.endswith(s)
    return out


def strip(c: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def first_chars(c: Column, n: int | None) -> Column:
    """The first n characters; None keeps the whole text."""
    return c if n is None else F.substring(c, 1, n)


def non_empty(c: Column) -> Column:
    """Array without null and '' members."""
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def distinct_tokens(*arrays: Column) -> Column:
    """First occurrence of each non-empty token over the arrays, order kept."""
    return F.array_distinct(non_empty(F.concat(*arrays)))


def fold(c: Column) -> Column:
    """Latin accents removed, case kept."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def split_identifier(c: Column) -> Column:
    """Camel, acronym and digit parts of an identifier, lowered, distinct, in order."""
    words = matches(F.coalesce(c, F.lit("")), "[A-Za-z0-9]+")  # an acronym ends at its word's end
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(matches(w, SUBWORD), F.lower))))


def index_terms(c: Column) -> Column:
    """Terms of an indexed text, repeats kept."""
    return matches(F.lower(fold(F.coalesce(c, F.lit("")))), WORD)


def query_terms(c: Column) -> Column:
    """Distinct search terms: each whole token, then its sub-words of two or more letters.

    The same tokenizer serves both sides, so accented words match; sub-words come from ASCII tokens.
    """
    words = F.array_distinct(matches(fold(F.coalesce(c, F.lit(""))), WORD))

    def expand(w: Column) -> Column:
        parts = F.filter(F.transform(matches(w, SUBWORD), F.lower),
                         lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9]+$"))
        mixed = w.rlike("^[A-Za-z0-9]+$") & w.rlike(MIXED)
        return F.when(mixed, F.concat(F.array(F.lower(w)), parts)).otherwise(F.array(F.lower(w)))

    return F.array_distinct(F.flatten(F.transform(words, expand)))


def unit_uid(repo: Column, kind: Column, qualified_name: Column, name: Column, text: Column) -> Column:
    """sha1 over the NUL-joined identity of an index row."""
    qn = F.coalesce(F.nullif(qualified_name, F.lit("")), name)
    return F.sha1(F.concat_ws("\u0000", repo, kind, qn, text))


def symbol_text(name: Column, label: Column, qn: Column, file: Column,
                source: Column | None = None, camelcase: bool = False) -> Column:
    """Search text of a symbol row, with optional source snippet and sub-words."""
    none_if_blank = [F.nullif(c, F.lit("")) for c in (name, label, qn, file)]
    text = F.concat_ws(" ", *none_if_blank)
    if source is not None:
        text = F.concat_ws("\n", text, F.nullif(source, F.lit("")))
    if camelcase:
        owner = F.coalesce(F.nullif(qn, F.lit("")), name)
        subs = F.array_distinct(F.concat(split_identifier(owner), split_identifier(name)))
        text = F.concat_ws("\n", text, F.nullif(F.array_join(subs, " "), F.lit("")))
    return text


HEADING = r"#{1,6}[^\S\n]+[^\n]*\S[^\S\n]*"


def markdown_sections(c: Column) -> Column:
    """array<struct<ord, heading, body>> by ATX heading; text before the first heading is dropped."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    chunks = F.filter(F.split(plain, rf"(?m)^(?={HEADING}$)"), lambda s: s.rlike(rf"\A{HEADING}(?:\n|\z)"))
    return F.transform(chunks, lambda s, i: F.struct(
        i.alias("ord"),
        F.trim(F.regexp_extract(s, r"\A#{1,6}[^\S\n]+([^\n]*\S)[^\S\n]*(?:\n|\z)", 1)).alias("heading"),
        F.regexp_replace(F.regexp_replace(s, r"\A[^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("body")))


def hash_embedding(c: Column, dim: int = 16) -> Column:
    """L2-normalised bucket counts of whitespace tokens by sha1; dim must be a power of two up to 65536."""
    if dim < 1 or dim > 65536 or dim & (dim - 1):
        raise ValueError(f"dim must be a power of two up to 65536, not {dim}")
    toks = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    buckets = F.transform(toks, lambda t: F.conv(F.substring(F.sha1(t), 37, 4), 16, 10).cast("int") % dim)
    counts = let(buckets, lambda bs: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda b: F.size(F.filter(bs, lambda x: x == b)).cast("double")))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    return let(counts, unit)


def opaque_id(slug: Column, number: Column) -> Column:
    return F.concat(F.lit("gl-"), F.substring(F.sha1(F.concat(slug, F.lit("#"), number.cast("string"))), 1, 12))


def stable_pick(case_id: Column, n: Column | int) -> Column:
    """Index in [0, n) from the first 8 bytes of the id's sha1."""
    head = F.conv(F.substring(F.sha1(case_id), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % (F.lit(n) if isinstance(n, int) else n)).cast("int")


def norm_path(c: Column) -> Column:
    """Bare repo-relative path: one a/ or b/ stripped, then ./, slashes collapsed."""
    p = F.regexp_replace(strip(c), r"\A[ab]/", "")
    return F.regexp_replace(F.regexp_replace(p, r"\A\./", ""), "/+", "/")


def canonical_path(c: Column) -> Column:
    """Package-qualified suffix of a path after its first listed source-root marker."""
    p = norm_path(c)
    out = p
    for root in reversed(V.SOURCE_ROOTS):
        out = F.when(p.startswith(root), p.substr(F.lit(len(root) + 1), F.length(p))).otherwise(out)
    for root in reversed(V.SOURCE_ROOTS):
        mark = "/" + root
        at = F.instr(p, mark)
        out = F.when(at > 0, p.substr(at + len(mark), F.length(p))).otherwise(out)
    return out


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def module_path(c: Column) -> Column:
    """Source path as a dotted module path."""
    ext = "|".join(e.replace(".", r"\.") for e in dict.fromkeys(V.MODULE_EXTENSIONS))
    return F.replace(F.regexp_replace(c, rf"(?:{ext})\z", ""), F.lit("/"), F.lit("."))


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    table = F.create_map(*[F.lit(x) for kv in V.LANGUAGES.items() for x in kv])
    return table[ext]


def squeeze(c: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_prose(summary: Column, description: Column) -> Column:
    return squeeze(F.lower(F.concat(F.coalesce(summary, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))))


def code_query(signals: Column) -> Column:
    """Distinct code tokens of a signals struct as one query text, '' when there are none."""
    order = ["classes", "methods", "packages", "symbols", "libraries"]
    return F.array_join(distinct_tokens(*[signals[f] for f in order]), " ")


def anchor_candidates(c: Column) -> Column:
    """Literal anchors of prose: quoted and backtick spans, camel case, dotted, all caps.

    The first casing of each candidate is kept; quoted and backtick spans skip the stop list and the
    number filter.
    """
    text = F.coalesce(c, F.lit(""))
    span = r"""\"([^\"]{2,60})\"|'([^']{2,60})'"""
    quoted_spans = F.transform(matches(text, span), lambda s: s.substr(F.lit(2), F.length(s) - 2))
    ticks = groups(text, r"`([^`]{2,60})`")
    shapes = F.concat(
        matches(text, r"(?U)\b[A-Za-z]*[a-z][A-Z]\w*\b|\b[A-Z]{2,}[a-z]\w*\b"),
        matches(text, r"(?U)\b\w+[._]\w[\w._]*\b"),
        matches(text, r"(?U)\b[A-Z]{2,5}\b"))
    kept = F.filter(shapes, lambda s: ~in_list(F.lower(s), V.ANCHOR_STOPLIST)
                    & ~s.rlike(r"(?i)\Av?\d+(?:[._]\d+)*[a-z]{0,3}\z"))
    found = F.filter(F.transform(F.concat(quoted_spans, ticks, kept), strip), lambda s: s != "")

    def first_wins(cands: Column) -> Column:
        return let(F.transform(cands, F.lower), lambda low: F.filter(
            cands, lambda s, i: F.array_position(low, F.get(low, i)) == i + 1))

    return let(found, first_wins)


def parse_source_path(path: Column) -> Column:
    """struct<lang, package, class> of a source path; null language for tests and other files."""
    in_tests = path.rlike(r"/(?:test|androidTest)/")
    jvm = F.regexp_extract(path, r"/(?:java|kotlin)/([^\n]+)\.(?:java|kt)$", 1)
    native = F.regexp_extract(path, r"([A-Za-z0-9_]+)\.(?:cpp|cc|cxx|c|mm)$", 1)
    is_jvm, is_native = ~in_tests & (jvm != ""), ~in_tests & (jvm == "") & (native != "")
    package = F.when(jvm.contains("/"), F.replace(F.regexp_replace(jvm, r"/[^/]*\z", ""), F.lit("/"), F.lit(".")))
    return F.struct(
        F.when(is_jvm, F.lit("java")).when(is_native, F.lit("native")).alias("lang"),
        F.when(is_jvm, F.coalesce(package, F.lit(""))).when(is_native, F.lit("")).alias("package"),
        F.when(is_jvm, basename(jvm)).when(is_native, native).alias("class"))


def symbol_source(src: Column, name: Column, start: Column, end: Column, max_chars: int | None = None,
                  doc_lines: int = 6, body_lines: int = 3) -> Column:
    """Doc comment above a symbol plus its signature lines, whole unless max_chars cuts it.

    Uses the given 1-based line span, else the first line that names the symbol with a definition
    mark, else the first line that names it.
    """
    def region(lines: Column) -> Column:
        n = F.size(lines)
        whole = F.concat(F.lit(r"(?U)\b"), quoted(name), F.lit(r"\b"))
        named = F.transform(lines, lambda s: F.regexp_like(s, whole))
        marked = F.transform(lines, lambda s: F.regexp_like(s, whole) & has_any(s, ["(", "{", "#define", "typedef"]))
        grep = F.coalesce(F.nullif(F.array_position(marked, True), F.lit(0)), F.array_position(named, True))
        given = F.coalesce(start, F.lit(0))
        at = F.when((given >= 1) & (given <= n), given.cast("long")).otherwise(grep)
        reach = at + body_lines
        last = F.when(F.coalesce(end, F.lit(0)) > given, end.cast("long")).otherwise(reach)
        stop = F.least(last, reach, n.cast("long"))
        return F.struct(lines.alias("lines"), at.alias("at"), stop.alias("stop"))

    def cut_out(r: Column) -> Column:
        above, run = F.lit(0), F.lit(True)
        for back in range(1, doc_lines + 1):
            pos = F.greatest(r["at"] - back, F.lit(1)).cast("int")
            line = strip(F.coalesce(F.try_element_at(r["lines"], pos), F.lit("")))
            run = run & (r["at"] - back >= 1) & (starts_any(line, ["//", "/*", "*"]) | line.endswith("*/"))
            above = F.when(run, F.lit(back)).otherwise(above)
        begin = F.greatest(r["at"] - above, F.lit(1)).cast("int")
        picked = F.slice(r["lines"], begin, F.greatest(r["stop"] - begin + 1, F.lit(0)).cast("int"))
        body = F.regexp_replace(F.array_join(picked, "\n"), r"\A\s+|\s+\z", "")
        return F.when(r["at"] < 1, F.lit("")).otherwise(first_chars(body, max_chars))

    lines = F.split(F.regexp_replace(src, r"\r\n?", "\n"), "\n")
    blank = (F.coalesce(src, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == "")
    return F.when(blank, F.lit("")).otherwise(let(let(lines, region), cut_out))
