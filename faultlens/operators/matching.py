"""Many literals and patterns against many texts, without Python rows: an index of rare grams proposes, the JVM verifies.

A literal can only occur where each of its grams occurs, and a gram of word characters lies within one word of the text. So every literal is
known by its rarest gram, texts meet the index by their distinct words, and what meets is verified on the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.session import cut, small

GRAM = 4
RUN = r"[\p{L}\p{N}_]+"


def required(pattern: Column) -> Column:
    """The longest run of word characters that every match of a pattern holds, '' where none is sure.

    Patterns with alternatives, option groups or optional groups promise none; elsewhere escapes, classes and characters that may be absent
    are taken out first.
    """
    unsure = F.regexp_like(pattern, F.lit(r"\||\(\?|\)[?*{]"))
    plain = F.regexp_replace(pattern, r"\\[pP]\{[^}]*\}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.", " ")
    plain = F.regexp_replace(plain, r"\[\^?\]?[^\]]*\]", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r".[?*]|.\{[^}]*\}", " "), r"[^\p{L}\p{N}_]", " ")
    runs = F.regexp_extract_all(plain, F.lit(RUN), 0)
    longest = F.element_at(F.array_sort(runs, lambda a, b: F.length(a) - F.length(b)), -1)
    return F.when(unsure | (F.size(runs) == 0), "").otherwise(F.lower(longest))


def _of(w: Column, n: int) -> Column:
    """The parts of n characters of a word."""
    return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _grams(sizes: dict[int, list[str]]) -> Column:
    """The distinct grams of column `word`: of each size those of the fields that ask for it, and '' of ''."""
    none = F.array().cast("array<string>")
    word, field = F.col("word"), F.col("field")
    return F.array_distinct(F.concat(*[F.when(field.isin(fields), _of(word, n)).otherwise(none) for n, fields in sizes.items()],
                                     F.when(word == "", F.array(F.lit(""))).otherwise(none)))


def _keys(needle: Column) -> Column:
    """Grams that may stand for a needle: those of GRAM characters; of a needle with shorter runs only, its runs; '' of one without any."""
    runs = F.array_distinct(F.regexp_extract_all(needle, F.lit(RUN), 0))
    long_ = F.array_distinct(F.flatten(F.transform(runs, lambda w: _of(w, GRAM))))
    return F.when(F.size(long_) > 0, long_).when(F.size(runs) > 0, runs).otherwise(F.array(F.lit("")))


def identity(*cols: str) -> Column:
    """The number that a (field, kind, value) goes by."""
    return F.xxhash64(*cols)


def matches(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct (row, id) of the wanted that hold, id being `identity` of (field, kind, value).

    fields is (row, field, hay, toks): a text, and the tokens it was joined from, or null where it is one text. wanted is (field, kind, value) with kind
    'literal' (the text contains the value) or 'pattern' (a Java regular expression, case aside, that the text, or one of the tokens, holds). Literals
    are compared as they are. Null texts and values hold nothing; equal rows of wanted count once. fields should rest on a written table.
    """
    return matches_and_groups(fields, wanted)[0]


def matches_and_groups(fields: DataFrame, wanted: DataFrame, together: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """`matches`, and (row, group, others) of groups that may hold.

    together is (group, field, kind, value) of what must hold at once: only the member of a group whose gram is rarest here is looked for. Where it
    holds the group is proposed with the values of the others, rarest first, which are left to the caller. Null values are left out.
    """
    cols = ["field", "kind", "value"]
    single = wanted.select(*cols).where("value IS NOT NULL").distinct()
    grouped = None if together is None else cut(together.where("value IS NOT NULL").select("group", *cols).distinct().withColumn("id", identity(*cols)))
    asked = (single if grouped is None else single.unionByName(grouped.select(*cols)).distinct()).withColumn("id", identity(*cols))
    needle = F.when(F.col("kind") == "literal", F.col("value")).otherwise(required(F.col("value")))
    # a literal of one run of word characters holds where a word holds it: that is settled once a word, not once a text
    one = (F.col("kind") == "literal") & F.regexp_like("value", F.lit(rf"\A{RUN}\z"))
    keys = cut(asked.select("id", "field", F.when(one, F.col("value")).alias("inside"), F.explode(_keys(needle)).alias("gram")))
    sizes = {}
    for r in keys.select("field", F.length("gram").alias("n")).where(f"n BETWEEN 1 AND {GRAM}").distinct().collect():  # a few fields by GRAM sizes
        sizes.setdefault(r.n, []).append(r.field)
    # explode() would have its array made once more, to leave out empty ones
    spoken = fields.select("row", "field", F.explode_outer(F.array_union(F.array(F.lit("")), F.array_distinct(F.regexp_extract_all("hay", F.lit(RUN), 0)))).alias("word"))
    words = cut(spoken.where("word IS NOT NULL"))
    counts = words.groupBy("field", "word").agg(F.count("*").alias("n")).withColumn("w", F.xxhash64("field", "word"))
    seen = cut(counts.select("w", "field", "word", "n", F.explode_outer(_grams(sizes)).alias("gram")).join(keys.select("field", "gram").distinct(), ["field", "gram"], "left_semi"))
    often = seen.groupBy("field", "gram").agg(F.sum("n").alias("often"))
    ranked = cut(keys.join(often, ["field", "gram"], "left").groupBy("id", "field", "inside").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("k")))
    index = ranked.where("k.often > 0").select("id", "field", "inside", F.col("k.gram").alias("gram"))
    if grouped is not None:
        listed = grouped.select("group", "id", "value").join(ranked.select("id", "k.often"), "id").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("often", "id", "value"))).alias("m"))
        rarest = cut(listed.select("group", F.get("m.id", F.lit(0)).alias("id"), F.slice("m.value", F.lit(2), F.size("m")).alias("others")))
        index = index.join(rarest.select("id").unionByName(single.select(identity(*cols).alias("id"))).distinct(), "id", "left_semi")
    met = cut(seen.join(index, ["field", "gram"]).where(F.col("inside").isNull() | F.contains("word", "inside")).select("w", "id", F.col("inside").isNotNull().alias("one")))
    found = cut(words.select("row", F.xxhash64("field", "word").alias("w")).join(F.broadcast(met) if small(met) else met, "w").select("row", "id", "one").distinct())

    def holds(v: Column) -> Column:
        p = F.concat(F.lit("(?iU)"), v["value"])
        fits = F.when(F.col("toks").isNull(), F.regexp_like("hay", p)).otherwise(F.exists("toks", lambda t: F.regexp_like(t, p)))
        return F.when(v["kind"] == "literal", F.contains(F.col("hay"), v["value"])).otherwise(fits)

    opened = found.where("NOT one").join(asked, "id").groupBy("row", "field").agg(F.collect_list(F.struct("id", "kind", "value")).alias("open"))
    verified = opened.join(fields, ["row", "field"]).select("row", F.explode_outer(F.filter("open", holds)).alias("v")).where("v IS NOT NULL")
    held = found.where("one").select("row", "id").unionByName(verified.select("row", "v.id"))
    if grouped is None:
        return held, None
    proposed = held.join(rarest, "id").select("row", "group", "others")
    return held.join(single.select(identity(*cols).alias("id")), "id", "left_semi"), proposed
