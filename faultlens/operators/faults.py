"""Fault extraction from log lines: anchor, block, blamed frame, and signals of the fault site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultlens import fixed_values as V
from faultlens.functions import logs as L
from faultlens.functions import text as T
from faultlens.operators.lexical import top_k
from faultlens.session import cut, join_large, join_sized


def log_lines(attachments: DataFrame) -> DataFrame:
    """(case_id, line_no, raw) of attachments(case_id, ord, content), numbered in attachment order."""
    return attachments.select("case_id", "ord", F.posexplode(L.text_lines(F.col("content"))).alias("pos", "raw")).select(
        "case_id", (F.col("ord").cast("long") * F.lit(1 << 32) + F.col("pos")).alias("line_no"), "raw")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ts, pid, tid, level, tag and msg; unmatched lines keep their text as msg."""
    return lines.withColumn("_f", L.logcat_fields(F.col("raw"))).select(*lines.columns, "_f.*")


def anchors(parsed: DataFrame) -> DataFrame:
    """First fault anchor of each case: (case_id, anchor_no, family, pid, tag)."""
    family = L.anchor_family(F.col("tag"), F.col("msg"))
    hits = parsed.withColumn("family", family).where(F.col("family").isNotNull())
    first = hits.groupBy("case_id").agg(F.min(F.struct("line_no", "family", "pid", "tag")).alias("a"))
    return first.select("case_id", F.col("a.line_no").alias("anchor_no"), "a.family", "a.pid", "a.tag")


def blocks(parsed: DataFrame, found: DataFrame, size: int = V.BLOCK_LINES) -> DataFrame:
    """The anchor line and the lines after it, `size` in all, joined as one text per case.

    The line limit is applied per partition before the shuffle, so a case with a huge log never
    reaches one task whole.
    """
    after = join_sized(parsed.select("case_id", "line_no", F.coalesce(F.nullif("msg", F.lit("")), "raw").alias("line")),
                       found, ["case_id"]).where(F.col("line_no") >= F.col("anchor_no"))
    kept = top_k(after, size, ["case_id"], [F.col("line_no")])
    joined = kept.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("b"), F.count("*").alias("n_lines"))
    text = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    return joined.select("case_id", text.alias("block"), "n_lines").join(found, "case_id")


def fault_records(parsed: DataFrame, size: int = V.BLOCK_LINES) -> DataFrame:
    """One record per case with an anchor and at least one frame."""
    # the cheap test first: a filter on the frames themselves would be pushed down and parse them twice
    framed = blocks(parsed, cut(anchors(parsed)), size).where(L.any_match(F.col("block"), [L.JAVA_FRAME, L.NATIVE_FRAME]))
    rows = framed.withColumn("frames", L.frames(F.col("block"))).withColumn("blame", L.blame(F.col("frames")))
    return rows.select(
        "case_id", "family", F.regexp_extract("block", L.EXCEPTION, 1).alias("exception"), "frames",
        F.col("blame.top").alias("top_frame"), L.frame_key(F.col("blame.top")).alias("top_frame_key"),
        F.transform("frames", L.frame_key).alias("blamed_keys"),
        L.file_hint(F.col("blame.top")).alias("fault_file_hint"), "pid", "tag",
        F.col("blame.confidence").alias("confidence"))


def fault_signals(records: DataFrame) -> DataFrame:
    """(case_id, signals) of the fault site only."""
    return records.select("case_id", L.fault_signals(F.col("frames"), F.col("top_frame"), F.col("exception")).alias("signals"))


def extract_signals(tickets: DataFrame, text_only: bool = False) -> DataFrame:
    """(case_id, signals) of tickets(case_id, description, log_text); text_only leaves the logs out."""
    log = F.lit("") if text_only else F.col("log_text")
    return tickets.select("case_id", L.signals(log, F.col("description")).alias("signals"))


def signal_rows(signals: DataFrame) -> DataFrame:
    """Long form (case_id, family, pos, token) of a signals struct."""
    def family(name: str):
        return F.transform(F.col(f"signals.{name}"), lambda t, i: F.struct(
            F.lit(name).alias("family"), i.alias("pos"), t.alias("token")))

    rows = F.concat(*[family(f) for f in V.SIGNAL_FAMILIES])
    return signals.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.family", "r.pos", "r.token")


def case_tokens(signals: DataFrame) -> DataFrame:
    """Distinct (case_id, token) over all families."""
    return signals.select("case_id", F.explode(L.signal_tokens(F.col("signals"))).alias("token"))


def dispatch_signals(tickets: DataFrame, records: DataFrame) -> DataFrame:
    """Fault signals for cases with a fault record, else prose: (case_id, is_prose, prose_query, component, signals).

    The prose query and the component travel as columns; log tokens of prose cases keep their families
    without native symbols.
    """
    base = tickets.join(fault_signals(records).withColumnRenamed("signals", "fault"), "case_id", "left")
    sig = L.signals(F.col("log_text"), F.lit(""))
    prose = F.struct(sig["packages"].alias("packages"), sig["classes"].alias("classes"), sig["methods"].alias("methods"),
                     F.array().cast("array<string>").alias("symbols"), sig["libraries"].alias("libraries"),
                     sig["errors"].alias("errors"))
    is_prose = F.col("fault").isNull()
    return base.select(
        "case_id", is_prose.alias("is_prose"),
        F.when(is_prose, T.normalize_prose(F.col("summary"), F.col("description"))).otherwise(F.lit("")).alias("prose_query"),
        F.trim(F.coalesce("component", F.lit(""))).alias("component"), F.coalesce("fault", prose).alias("signals"))


def stamp_bug_kind(labels: DataFrame) -> DataFrame:
    crash = F.length(F.coalesce("fault_frame", F.lit(""))) > 0
    return labels.withColumn("bug_kind", F.when(crash, F.lit("crash")).otherwise(F.lit("functional")))


def crash_frames(files: DataFrame, symbols: DataFrame, limit: int = 3) -> DataFrame:
    """First `limit` indexable files of a case with a method name drawn from the index.

    files is (case_id, repo, pos, file); symbols is (repo, uid, name, label, file). A symbol belongs
    to a file when its own file's basename ends with the same basename. Without a symbol the method is
    a stable choice from fixed names.
    """
    parsed = files.withColumn("_p", T.parse_source_path(F.col("file"))).where(F.col("_p.lang").isNotNull())
    picked = top_k(parsed, limit, ["case_id"], [F.col("pos")]).withColumn("base", T.basename(F.col("file")))
    named = symbols.where(F.col("label").isin("Method", "Function") & F.col("name").rlike(r"\A[A-Za-z_]\w*\z"))
    # every suffix of a symbol's basename, so "ends with" is an equi-join
    tail = T.basename(F.col("file"))
    by_tail = named.select("repo", "uid", "name", F.explode(F.transform(
        F.sequence(F.lit(1), F.length(tail)), lambda i: F.substring(tail, i, F.length(tail)))).alias("base"))
    wanted = picked.select("repo", "base", F.col("_p.class").alias("cls")).distinct()
    found = join_large(by_tail, wanted, ["repo", "base"]).where(F.col("name") != F.col("cls"))
    first = found.groupBy("repo", "base", "cls").agg(F.min_by("name", "uid").alias("method"))
    fixed = F.array(*[F.lit(m) for m in ("<init>", "run", "process", "onEvent")])
    spare = F.get(fixed, T.stable_pick(F.concat_ws("#", F.col("case_id").cast("string"), "file"), 4))
    return (picked.withColumn("cls", F.col("_p.class")).join(first, ["repo", "base", "cls"], "left")
            .select("case_id", "rank", F.col("_p.package").alias("package"), "cls",
                    F.coalesce("method", spare).alias("method"), F.col("base").alias("filename")))


def pick_class(cases: DataFrame, classes: DataFrame) -> DataFrame:
    """One crash class per case: those of its surface that allow its owner, chosen by a stable hash.

    cases is (case_id, owner, surface); classes is (ord, class_name, surface, affinity array or null).
    """
    pairs = cases.select("owner", "surface").distinct().join(classes, "surface").where(
        F.col("affinity").isNull() | F.array_contains("affinity", F.col("owner")))
    options = pairs.groupBy("owner", "surface").agg(F.sort_array(F.collect_list(F.struct("ord", "class_name"))).alias("options"))
    row = join_sized(cases, options, ["owner", "surface"])
    at = T.stable_pick(F.col("case_id").cast("string"), F.size("options"))
    return row.select("case_id", F.get("options", at)["class_name"].alias("class_name"))


def unfenced_runs(texts: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least `least` consecutive log-like lines: (id, start, n_lines, kind, text).

    texts is (id, text). Only log-like lines are shuffled; position minus running number marks a run.
    """
    lines = texts.select("id", F.posexplode(L.text_lines(F.col("text"))).alias("pos", "line")).where(
        L.is_log_line(F.col("line")))
    w = W.partitionBy("id").orderBy("pos")
    runs = lines.withColumn("_run", F.col("pos") - F.row_number().over(w))
    grouped = runs.groupBy("id", "_run").agg(
        F.min("pos").alias("start"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return grouped.where(F.col("n_lines") >= least).select(
        "id", "start", "n_lines", L.classify_block(F.col("text")).alias("kind"), "text")


def split_bodies(issues: DataFrame) -> DataFrame:
    """(id, prose, logs) of issue bodies(id, body): fenced logs, then unfenced runs, template lines dropped."""
    cut_text = issues.select("id", L.fenced_logs(F.col("body")).alias("fenced"), L.without_log_fences(F.col("body")).alias("text"))
    runs = unfenced_runs(cut_text.select("id", "text")).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("start", "n_lines", "kind", "text"))).alias("runs"))
    rows = cut_text.join(runs, "id", "left").withColumn(
        "runs", F.coalesce("runs", F.array().cast("array<struct<start:int,n_lines:bigint,kind:string,text:string>>")))
    kept = F.filter(L.text_lines(F.col("text")), lambda s, i: ~F.exists(
        F.col("runs"), lambda r: (i >= r["start"]) & (i < r["start"] + r["n_lines"])))
    extra = F.transform("runs", lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text")))
    return rows.select("id", L.strip_template(F.array_join(kept, "\n")).alias("prose"), F.concat("fenced", extra).alias("logs"))
