"""Case directories: tickets, attachments, catalogs, hidden labels, and the mined-case sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.sources.files import json_files, json_rows, segment, whole_texts

TICKET = ("struct<id:string,summary:string,description:string,component:string,status:string,comments:array<map<string,string>>,"
          "logs:array<struct<path:string,kind:string,content:string>>>")
LABEL = ("struct<owning_repo:string,expected_files:array<string>,required_apis:array<string>,is_answerable:boolean,negative_class:string,"
         "held_out_repo:string,bug_kind:string,fault_frame:string,fault_file:string,owning_repo_sha:string,fix_patch:string>")
CATALOG = "array<struct<name:string>>"


def _or(c: str, default: Column) -> Column:
    return F.coalesce(F.col(c), default).alias(c.split(".")[-1])


def load_cases(spark: SparkSession, root: str) -> DataFrame:
    """One row per case directory with a ticket.json; hidden folders are never read."""
    return cases_of(whole_texts(spark, f"{root}/*/ticket.json"))


def cases_of(texts: DataFrame) -> DataFrame:
    """Cases of ticket texts(path, text); the folder names the case."""
    rows = json_rows(texts, TICKET)
    none = F.array()
    return rows.select(
        segment(F.col("path"), 2).alias("case_id"), F.col("v.id").alias("ticket_id"), _or("v.summary", F.lit("")), _or("v.description", F.lit("")),
        _or("v.component", F.lit("")), _or("v.status", F.lit("Open")), _or("v.comments", none.cast("array<map<string,string>>")),
        _or("v.logs", none.cast("array<struct<path:string,kind:string,content:string>>")))


def load_tickets(spark: SparkSession, root: str, log_glob: str = "logs/*", missing: str = "fail") -> DataFrame:
    """Cases with their attachments resolved to text, in ticket order, and all log text joined.

    A listed attachment that is neither a file nor given in the ticket fails the job; missing='null' keeps it with a null content.
    """
    return with_attachments(load_cases(spark, root), whole_texts(spark, f"{root}/*/{log_glob}"), log_glob.count("/") + 1, missing)


def with_attachments(cases: DataFrame, texts: DataFrame, depth: int = 2, missing: str = "fail") -> DataFrame:
    """Cases with the texts(path, text) that their tickets list; an attachment's path has `depth` segments below the case's folder."""
    if missing not in ("fail", "null"):
        raise ValueError(f"missing must be 'fail' or 'null', not {missing!r}")
    files = texts.select(segment(F.col("path"), depth + 1).alias("case_id"), F.substring_index("path", "/", -depth).alias("path"),
                         F.col("text").alias("disk"))
    asked = cases.select("case_id", F.posexplode("logs").alias("pos", "g")).select(
        "case_id", "pos", F.col("g.path").alias("path"), F.coalesce("g.kind", F.lit("other")).alias("kind"), F.col("g.content").alias("inline"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("missing attachment"), "case_id", "path")).cast("string") if missing == "fail" else F.lit(None).cast("string")
    found = asked.join(files, ["case_id", "path"], "left").withColumn("content", F.coalesce("disk", "inline", lost))
    logs = found.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "path", "kind", "content"))).alias("l")).select(
        "case_id", F.transform("l", lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind"), x["content"].alias("content"))).alias("logs"))
    out = cases.drop("logs").join(logs, "case_id", "left")
    empty = F.array().cast("array<struct<path:string,kind:string,content:string>>")
    return out.withColumn("logs", F.coalesce("logs", empty)).withColumn(
        "log_text", F.array_join(F.transform("logs", lambda x: x["content"]), "\n"))


def attachments(tickets: DataFrame) -> DataFrame:
    """(case_id, ord, content) rows for the log operators."""
    return tickets.select("case_id", F.posexplode("logs").alias("ord", "g")).select("case_id", "ord", F.col("g.content").alias("content"))


def load_labels(spark: SparkSession, root: str) -> DataFrame:
    """Hidden labels; grading only. Needs the explicit glob, a recursive listing skips _-folders."""
    return labels_of(whole_texts(spark, f"{root}/*/_oracle/oracle.json"))


def labels_of(texts: DataFrame) -> DataFrame:
    """Labels of hidden label texts(path, text)."""
    rows = json_rows(texts, LABEL)
    none = F.array().cast("array<string>")
    return rows.select(segment(F.col("path"), 3).alias("case_id"), "v.*").withColumns({
        "is_answerable": F.coalesce("is_answerable", F.lit(True)), "expected_files": F.coalesce("expected_files", none),
        "required_apis": F.coalesce("required_apis", none)})


def global_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(repo, pos) of root/catalog.json."""
    return json_files(spark, f"{root}/catalog.json", CATALOG).select(F.posexplode("v").alias("pos", "r")).select(F.col("r.name").alias("repo"), "pos")


def case_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, repo, pos) of the cases that bring their own catalog."""
    rows = json_files(spark, f"{root}/*/catalog.json", CATALOG)
    return rows.select(segment(F.col("path"), 2).alias("case_id"), F.posexplode("v").alias("pos", "r")).select("case_id", F.col("r.name").alias("repo"), "pos")


def combine_cases(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of case frames with their source; a case id in two sources fails the job."""
    every = reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in sources.items()])
    twice = every.groupBy("case_id").agg(F.count("*").alias("_n"), F.min("source").alias("_first"))
    fail = F.raise_error(F.concat(F.lit("case id collision: "), F.col("case_id").cast("string"))).cast("string")
    return every.join(twice, "case_id").withColumn(
        "source", F.when(F.col("_n") > 1, fail).otherwise(F.col("source"))).drop("_n", "_first")


def combine_catalogs(catalogs: list[DataFrame]) -> DataFrame:
    """Union of catalogs; the first source that names a repo gives its position."""
    rows = reduce(DataFrame.unionByName, [c.select("repo", F.lit(i).alias("o"), "pos") for i, c in enumerate(catalogs)])
    return rows.groupBy("repo").agg(F.min(F.struct("o", "pos")).alias("at")).select("repo", F.col("at.o").alias("source_pos"), F.col("at.pos").alias("pos"))


def source_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("source").agg(F.count("*").alias("cases"))


def checked_cases(cases: DataFrame) -> DataFrame:
    """Mined cases whose negative class is known and whose catalog leaves the held-out repo out."""
    bad_class = F.col("negative_class").isNotNull() & ~F.col("negative_class").isin(*V.NEGATIVE_CLASSES)
    shown = F.coalesce(F.array_contains("case_catalog", F.col("held_out_repo")), F.lit(False))
    fail = F.raise_error(F.when(bad_class, F.concat(F.lit("unknown negative_class: "), "negative_class")).otherwise(
        F.lit("held_out_repo must be excluded from the case catalog"))).cast("string")
    return cases.withColumn("negative_class", F.when(bad_class | shown, fail).otherwise(F.col("negative_class")))


def write_mined(cases: DataFrame, path: str) -> None:
    """Visible and hidden tables of mined cases; owner-bearing columns go to the hidden one only."""
    ok = checked_cases(cases)
    ok.select("case_id", "summary", "description", F.lit("").alias("component"), F.lit("Open").alias("status"), "logs", "case_catalog").write.mode(
        "overwrite").parquet(f"{path}/visible")
    ok.select("case_id", "owning_repo", "expected_files", "required_apis", "fix_patch", "is_answerable", "negative_class", "held_out_repo").write.mode(
        "overwrite").parquet(f"{path}/hidden")


def read_mined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/visible"), spark.read.parquet(f"{path}/hidden")


E2E = ("repo string, issue_number bigint, issue_url string, pr_number bigint, pr_url string, base_sha string, fix_sha string, owning_repo string, "
       "expected_files array<string>, required_apis array<string>")


def write_recipes(cases: DataFrame, path: str) -> None:
    """End-to-end case recipes as JSON lines, range-sorted by (repo, issue_number)."""
    cases.select("repo", "issue_number", "issue_url", "pr_number", "pr_url", "base_sha", "fix_sha", "owning_repo", "expected_files", "required_apis").orderBy(
        "repo", "issue_number").write.mode("overwrite").json(path)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(E2E).json(path)
