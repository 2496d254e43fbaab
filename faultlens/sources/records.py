"""Run records, plan archive, manifests, affinity, rule stores, entity maps, wikis and registries."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import text as T
from faultlens.sources.files import json_files, segment, whole_texts

RUN = (
    "ticket_id string, match_arm string, ranked array<struct<repo:string,score:double,evidence:array<string>>>, chosen string, "
    "locations array<string>, patch struct<diff:string,files:array<string>>, patch_applies boolean, change_id string, bound boolean, bind_kind string, "
    "events array<string>, materialize struct<repo:string,path:string,present:boolean,n_files:bigint>, "
    "signals struct<packages:array<string>,classes:array<string>,methods:array<string>,symbols:array<string>,libraries:array<string>,errors:array<string>>, "
    "cost_usd double, tokens struct<input:bigint,output:bigint>, model_calls bigint, fixer string")
LABEL_COLUMNS = {"owning_repo", "expected_files", "required_apis"}


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records as JSON; a label column is refused."""
    leaked = LABEL_COLUMNS & set(runs.columns)
    if leaked:
        raise ValueError(f"label columns in run records: {sorted(leaked)}")
    runs.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(RUN).json(path)
    none = F.array().cast("array<string>")
    return df.withColumns({"bind_kind": F.coalesce("bind_kind", F.lit("mock")), "cost_usd": F.coalesce("cost_usd", F.lit(0.0)),
                           "fixer": F.coalesce("fixer", F.lit("")), "locations": F.coalesce("locations", none)})


ARCHIVE = ("struct<schema:int,case_id:string,arm:string,predicted_repo:string,plan:string,fired_skills:array<string>,fired_knowledge:array<string>,"
           "outcome:struct<groundedness:double,replans:int,abstained:boolean,patch_emitted:boolean,patch_applies:boolean>>")


def archive_plans(records: DataFrame, path: str) -> None:
    """Records that carry a plan, one JSON object each; records is flat with plan as JSON text."""
    kept = records.where(F.coalesce("plan", F.lit("")).rlike(r"\S") & (F.col("plan") != "{}"))
    kept.select(F.lit(1).alias("schema"), "case_id", "arm", "predicted_repo", "plan", "fired_skills", "fired_knowledge", F.struct(
        "groundedness", "replans", "abstained", "patch_emitted", "patch_applies").alias("outcome")).write.mode("overwrite").json(path)


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    """Flat archive rows; malformed lines are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", ARCHIVE).alias("p")).where(F.col("p.case_id").isNotNull())
    return rows.select("p.case_id", "p.arm", "p.plan", F.col("p.fired_knowledge").alias("fired"), "p.outcome.groundedness", "p.outcome.patch_applies")


def batch_manifest(spark: SparkSession, affinity_path: str | None, **config: str) -> DataFrame:
    """One row: the batch configuration and the content hash of the affinity artifact."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in config.items()], F.current_timestamp().cast("string").alias("timestamp"))
    if not affinity_path:
        return row.withColumn("affinity_sha1", F.lit(""))
    content = spark.read.format("binaryFile").load(affinity_path)
    files = F.sort_array(F.collect_list(F.sha1("content")))
    digest = F.when(F.size(files) == 1, F.get(files, F.lit(0))).otherwise(F.sha1(F.array_join(files, "")))
    return row.withColumn("one", F.lit(1)).join(content.agg(digest.alias("affinity_sha1"), F.lit(1).alias("one")), "one").drop("one")


def write_affinity(counts: DataFrame, path: str) -> None:
    counts.select("component", "repo", "n").write.mode("overwrite").parquet(path)


def read_affinity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def affinity_from_json(texts: DataFrame) -> DataFrame:
    """(component, repo, n) of artifact texts holding {component: {repo: n}}."""
    outer = texts.select(F.explode(F.from_json("text", "map<string,map<string,int>>")).alias("component", "repos"))
    return outer.select("component", F.explode("repos").alias("repo", "n"))


ITEM = ("struct<id:string,applies_when:map<string,array<string>>,grounding_refs:array<string>,provenance:string,tier:string,signature:string,"
        "localize:array<string>,fix:array<string>,required_apis:array<string>,"
        "evidence:struct<fail_count:int,demotions:array<string>,validating_case_ids:array<string>>>")


def knowledge_from_json(texts: DataFrame) -> DataFrame:
    """Store items of texts holding {id: item}; unknown keys are dropped, the key is the default id."""
    rows = texts.select(F.explode(F.from_json("text", f"map<string,{ITEM}>")).alias("k", "v"))
    none = F.array().cast("array<string>")
    return rows.select(F.coalesce("v.id", "k").alias("id"), "v.applies_when", F.coalesce("v.grounding_refs", none).alias("refs"), "v.provenance", "v.tier",
                       F.coalesce("v.signature", F.lit("")).alias("signature"), F.coalesce("v.localize", none).alias("localize"),
                       F.coalesce("v.fix", none).alias("fix"), F.coalesce("v.required_apis", none).alias("required_apis"), "v.evidence")


def write_store(items: DataFrame, path: str) -> None:
    items.orderBy("id").write.mode("overwrite").json(path)


def load_rules_toml(spark: SparkSession, path: str) -> DataFrame:
    """Raw rules of a TOML corpus; a corpus is a hand-written dimension of a few hundred entries."""
    with open(path, "rb") as fh:
        entries = tomllib.load(fh).get("skill", [])
    rows = [(e.get("id", ""), e.get("provenance", ""), e.get("guidance", "").strip(), list(e.get("signals", ())), list(e.get("hint_apis", ())),
             {k: [str(x) for x in (v if isinstance(v, list) else [str(v).lower()])] for k, v in e.get("match", {}).items()}) for e in entries]
    return spark.createDataFrame(rows, "id string, provenance string, guidance string, signals array<string>, hint_apis array<string>, match map<string,array<string>>")


def rules_from_markdown(texts: DataFrame, triggers: DataFrame) -> DataFrame:
    """Rules of front-matter markdown(path, text): trigger names become match rows, equal ids fail the job.

    triggers is the mapping (trigger, key, value); an unknown trigger fails the job too.
    """
    head = F.regexp_extract("text", r"(?s)\A---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\z)", 1)
    body = T.strip(F.regexp_replace("text", r"(?s)\A---[^\S\n]*\n.*?\n---[^\S\n]*(?:\n|\z)", ""))

    def meta(name: str):
        return T.strip(F.regexp_extract("head", rf"(?m)^[^\S\n]*{name}[^\S\n]*:([^\n]*)$", 1))

    rows = texts.withColumns({"head": head, "guidance": body})
    rows = rows.select(meta("id").alias("id"), F.filter(F.transform(F.split(meta("triggers"), ","), lambda s: T.strip(s)), lambda s: s != "").alias("signals"),
                       F.coalesce(F.nullif(meta("provenance"), F.lit("")), F.concat(F.lit("md:"), T.basename(F.col("path")))).alias("provenance"), "guidance")
    n = rows.groupBy("id").agg(F.count("*").alias("_n"))
    fail = F.raise_error(F.concat(F.lit("duplicate skill id "), "id")).cast("string")
    once = rows.join(n, "id").withColumn("id", F.when(F.col("_n") > 1, fail).otherwise(F.col("id"))).drop("_n")
    asked = once.select("id", F.explode("signals").alias("trigger")).join(triggers, "trigger", "left")
    missing = F.raise_error(F.concat(F.lit("unknown trigger "), "trigger")).cast("string")
    per_key = asked.withColumn("key", F.when(F.col("key").isNull(), missing).otherwise(F.col("key"))).groupBy("id", "key").agg(
        F.array_sort(F.collect_set("value")).alias("values"))
    match = per_key.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("match"))
    return once.join(match, "id", "left").withColumn("match", F.coalesce("match", F.create_map().cast("map<string,array<string>>")))


def match_rows(rules: DataFrame) -> DataFrame:
    """Long (rule_id, key, value) rows of rules(id, match)."""
    return rules.select(F.col("id").alias("rule_id"), F.explode("match").alias("key", "vals")).select("rule_id", "key", F.explode("vals").alias("value"))


ENTITY = ("struct<built_at_repo_head:string,wiki_commit:string,graph_commit:string,modules:array<struct<module:string,wiki_page:string,path:string,"
          "entries:array<struct<symbol:string,file:string,node_id:string,lines:array<int>,match_strategy:string,confidence:double,stale:boolean>>>>>")


ENTRY = ["symbol", "file", "node_id", "lines", "match_strategy", "confidence", "stale"]


def flatten_entity_map(maps: DataFrame) -> DataFrame:
    """(repo, ord, module, wiki_page, symbol, file, node_id, lines, match_strategy, confidence, stale) of maps(repo, text)."""
    m = maps.select("repo", F.posexplode(F.from_json("text", ENTITY)["modules"]).alias("mo", "m"))
    e = m.select("repo", "mo", "m.module", "m.wiki_page", F.posexplode("m.entries").alias("eo", "e"))
    return e.select("repo", (F.shiftleft(F.col("mo").cast("long"), 32) + F.col("eo")).alias("ord"), "module", "wiki_page", *[f"e.{c}" for c in ENTRY])


def nest_entity_map(flat: DataFrame) -> DataFrame:
    """(repo, text) of flat entity rows, modules and entries in ord order."""
    kept = [c for c in ENTRY if c in flat.columns]
    entry = F.struct("ord", *[c for c in kept if c != "lines"], *[c for c in kept if c == "lines"])
    mods = flat.groupBy("repo", "module", "wiki_page").agg(F.min("ord").alias("o"), F.sort_array(F.collect_list(entry)).alias("es"))
    mods = mods.withColumn("entries", F.transform("es", lambda x: F.struct(
        *[x[c].alias(c) for c in kept])))
    out = mods.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("o", "module", "wiki_page", "entries"))).alias("ms"))
    return out.select("repo", F.to_json(F.struct(F.transform("ms", lambda x: F.struct(
        x["module"].alias("module"), x["wiki_page"].alias("wiki_page"), x["entries"].alias("entries"))).alias("modules"))).alias("text"))


def load_wiki(spark: SparkSession, root: str) -> DataFrame:
    """(repo, file, text) of root/<repo>/*.md: what the manifest lists, or all where there is none."""
    docs = whole_texts(spark, f"{root}/*/*.md").select(segment(F.col("path"), 2).alias("repo"), T.basename(F.col("path")).alias("file"), "text")
    meta = json_files(spark, f"{root}/*/metadata.json", "struct<files_generated:array<string>>").select(segment(F.col("path"), 2).alias("repo"), "v.files_generated")
    return listed_docs(docs, meta)


def listed_docs(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    listed = docs.join(manifests.select("repo", F.explode("files_generated").alias("file")).distinct(), ["repo", "file"], "left_semi")
    return listed.unionByName(docs.join(manifests.select("repo"), "repo", "left_anti"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Fleet registry rows of a TOML file, a small hand-kept dimension."""
    with open(path, "rb") as fh:
        entries = tomllib.load(fh).get("repo", [])
    rows = [(r.get("name"), r.get("repo_path"), r.get("wiki_dir"), r.get("entity_map", ""), r.get("url", ""), r.get("sha", "") or "") for r in entries]
    return spark.createDataFrame(rows, "repo string, repo_path string, wiki_dir string, entity_map string, url string, sha string")


def pinned_corpus(registry: DataFrame) -> DataFrame:
    """(repo, url, sha) rows with a url; the placeholder pin counts as none."""
    sha = F.when(F.coalesce("sha", F.lit("")) == V.UNPINNED, F.lit("")).otherwise(F.coalesce("sha", F.lit("")))
    return registry.where((F.coalesce("repo", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).select("repo", "url", sha.alias("sha"))
