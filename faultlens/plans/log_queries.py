"""Registered queries: log parsing, fault extraction, routing, priors and dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import logs as L
from faultlens.functions import text as T
from faultlens.operators import faults, grading, ranking
from faultlens.plans import tables as D
from faultlens.plans.vector_queries import ranked, rounded, sql_near, sql_vec_ranking, vec_hits
from faultlens.session import spread

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def log_lines(spark, d):
    """Every event as one log line of its user; the event id is the line number."""
    e = spread(D.load(spark, d, "events"))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    level = (F.when(kind == "error", "E").when(kind == "click", "I").when(kind == "view", "D").when(kind == "signup", "W").otherwise("V"))
    tag = F.when(kind == "error", "AndroidRuntime").when(kind == "purchase", "DEBUG").otherwise("App")
    msg = (F.when(kind == "error", D.cat("=FATAL EXCEPTION: worker-", k))
           .when(kind == "signup", D.cat("=java.lang.IllegalStateException: signup ", k))
           .when(kind == "click", D.cat("=at com.acme.click.p", k % 5, "=.Panel", k, "=.onTap(Panel", k, "=.java:", F.col("event_id") % 900 + 1, "=)"))
           .when(kind == "view", D.cat("=at android.view.View.performClick(View.java:", k, "=)"))
           .otherwise(D.cat("=#", F.lpad((k % 100).cast("string"), 2, "0"), "= pc 000000000004a", k % 10, "= /system/lib64/libcart",
                            k % 7, "=.so.1 (Cart", k % 3, "=::checkout+0x1c)")))
    head = F.date_format("ts", "MM-dd HH:mm:ss.SSS")
    line = D.cat(head, "=  ", "user_id", "=  ", F.col("event_id") % 1000, "= ", level, "= ", tag, "=: ", msg)
    raw = F.when(F.col("value") < 2, D.cat("=--- beginning of crash ", k)).otherwise(line)
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("line_no"), raw.alias("raw"))


RAW_SQL = """ev AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
raws AS (SELECT user_id AS case_id, event_id AS line_no, CASE WHEN value < 2 THEN '--- beginning of crash ' || k ELSE
  strftime(ts, '%m-%d %H:%M:%S.%g') || '  ' || user_id || '  ' || (event_id % 1000) || ' ' ||
  CASE event_type WHEN 'error' THEN 'E' WHEN 'click' THEN 'I' WHEN 'view' THEN 'D' WHEN 'signup' THEN 'W' ELSE 'V' END || ' ' ||
  CASE event_type WHEN 'error' THEN 'AndroidRuntime' WHEN 'purchase' THEN 'DEBUG' ELSE 'App' END || ': ' ||
  CASE event_type WHEN 'error' THEN 'FATAL EXCEPTION: worker-' || k
    WHEN 'signup' THEN 'java.lang.IllegalStateException: signup ' || k
    WHEN 'click' THEN 'at com.acme.click.p' || (k % 5) || '.Panel' || k || '.onTap(Panel' || k || '.java:' || (event_id % 900 + 1) || ')'
    WHEN 'view' THEN 'at android.view.View.performClick(View.java:' || k || ')'
    ELSE '#' || lpad((k % 100)::VARCHAR, 2, '0') || ' pc 000000000004a' || (k % 10) || ' /system/lib64/libcart' || (k % 7) ||
         '.so.1 (Cart' || (k % 3) || '::checkout+0x1c)' END END AS raw FROM ev)"""

LINE_RE = r"^((?:\d{4}-)?\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEFAS])\s+([^:]+?):\s?(.*)$"
LINES_SQL = f"""{RAW_SQL}, hit AS (SELECT *, regexp_matches(raw, '{LINE_RE}') AS ok FROM raws),
lines AS (SELECT case_id, line_no, raw, {', '.join(
    f"CASE WHEN ok THEN regexp_extract(raw, '{LINE_RE}', {i + 1}) END AS {n}" for i, n in enumerate(['ts', 'pid', 'tid', 'level', 'tag']))},
  CASE WHEN ok THEN regexp_extract(raw, '{LINE_RE}', 6) ELSE raw END AS msg FROM hit)"""


@query("logcat_lines", f"WITH {LINES_SQL} SELECT case_id, line_no, ts, pid, tid, level, tag, msg FROM lines")
def logcat_lines(spark, d):
    return faults.parse_lines(log_lines(spark, d)).drop("raw")


BLOCK_SQL = f"""{LINES_SQL},
fam AS (SELECT *, CASE WHEN contains(msg, 'FATAL EXCEPTION') THEN 'java'
   WHEN (tag = 'libc' AND contains(msg, 'Fatal signal')) OR regexp_matches(msg, '\\bsignal \\d+ \\(SIG') THEN 'native'
   WHEN contains(msg, 'ANR in') THEN 'anr' END AS family FROM lines),
anchor AS (SELECT case_id, min(line_no) AS anchor_no, arg_min(family, line_no) AS family, arg_min(pid, line_no) AS pid,
   arg_min(tag, line_no) AS tag FROM fam WHERE family IS NOT NULL GROUP BY 1),
after AS (SELECT l.*, a.anchor_no, row_number() OVER (PARTITION BY case_id ORDER BY line_no) AS rn
   FROM lines l JOIN (SELECT case_id, anchor_no FROM anchor) a USING (case_id) WHERE line_no >= anchor_no),
blk AS (SELECT * FROM after WHERE rn <= 400)"""


@query("fault_anchors", f"WITH {BLOCK_SQL} SELECT * FROM anchor")
def fault_anchors(spark, d):
    return faults.anchors(faults.parse_lines(log_lines(spark, d)))


@query("fault_blocks", f"""WITH {BLOCK_SQL} SELECT case_id, count(*) AS n_lines,
  md5(string_agg(CASE WHEN msg = '' THEN raw ELSE msg END, chr(10) ORDER BY line_no)) AS block_md5 FROM blk GROUP BY 1""")
def fault_blocks(spark, d):
    parsed = faults.parse_lines(log_lines(spark, d))
    return faults.blocks(parsed, faults.anchors(parsed)).select("case_id", "n_lines", F.md5("block").alias("block_md5"))


FRAMES_SQL = f"""{BLOCK_SQL},
fr AS (SELECT case_id, line_no, 0 AS side, regexp_extract(msg, 'at ([A-Za-z_][\\w.$]+)\\.([A-Za-z_<][\\w$>]*)\\(([^:)]+)', 1) AS fq,
         regexp_extract(msg, 'at ([A-Za-z_][\\w.$]+)\\.([A-Za-z_<][\\w$>]*)\\(([^:)]+)', 2) AS meth,
         regexp_extract(msg, 'at ([A-Za-z_][\\w.$]+)\\.([A-Za-z_<][\\w$>]*)\\(([^:)]+)', 3) AS hint, '' AS so
       FROM blk WHERE regexp_matches(msg, '\\bat [A-Za-z_][\\w.$]+\\.[A-Za-z_<][\\w$>]*\\([^)]+\\)')
  UNION ALL SELECT case_id, line_no, 1, split_part(sym, '::', 1), split_part(sym, '::', 2), NULL, so FROM (
     SELECT case_id, line_no, regexp_extract(msg, '(lib\\w+\\.so)', 1) AS so, regexp_extract(msg, '\\(([^+)]+)\\+0x', 1) AS sym FROM blk
     WHERE regexp_matches(msg, '#\\d+ pc [0-9a-f]+ \\S+\\.so'))),
keyed AS (SELECT *, CASE WHEN side = 0 THEN fq || '.' || meth ELSE fq || '::' || meth END AS key,
   CASE WHEN side = 0 THEN starts_with(fq, 'android.') ELSE so IN ('libc.so', 'libart.so') END AS fw,
   row_number() OVER (PARTITION BY case_id ORDER BY side, line_no) AS pos FROM fr),
exc AS (SELECT case_id, arg_min(regexp_extract(msg, '((?:[a-z]\\w*\\.)+[A-Z]\\w*(?:Error|Exception))', 1), line_no) AS exception
   FROM blk WHERE regexp_matches(msg, '^\\s*(?:[a-z]\\w*\\.)+[A-Z]\\w*(?:Error|Exception)') GROUP BY 1),
tops AS (SELECT case_id, count(*) AS n_frames, coalesce(arg_min(key, pos) FILTER (WHERE NOT fw), arg_min(key, pos)) AS top_frame_key,
   CASE WHEN count(*) FILTER (WHERE NOT fw) = 0 THEN arg_min(hint, pos) ELSE arg_min(coalesce(hint, ''), pos) FILTER (WHERE NOT fw) END AS hint,
   count(*) FILTER (WHERE NOT fw) > 0 AS owned, string_agg(key, ',' ORDER BY pos) AS keys FROM keyed GROUP BY 1),
recs AS (SELECT t.case_id, a.family, coalesce(e.exception, '') AS exception, n_frames, top_frame_key, nullif(hint, '') AS fault_file_hint,
   CASE WHEN owned THEN 'HIGH' ELSE 'LOW' END AS confidence, keys FROM tops t JOIN anchor a USING (case_id) LEFT JOIN exc e USING (case_id))"""


def records(spark, d):
    return faults.fault_records(faults.parse_lines(log_lines(spark, d)))


@query("fault_records", f"""WITH {FRAMES_SQL} SELECT case_id, family, exception, n_frames, top_frame_key, fault_file_hint, confidence,
  md5(keys) AS keys_md5 FROM recs""")
def fault_records(spark, d):
    return records(spark, d).select("case_id", "family", "exception", F.size("frames").cast("long").alias("n_frames"), "top_frame_key",
                                    "fault_file_hint", "confidence", F.md5(F.array_join("blamed_keys", ",")).alias("keys_md5"))


SIGNAL_SQL = f"""{FRAMES_SQL},
own AS (SELECT * FROM keyed WHERE NOT fw UNION ALL
        SELECT k.* FROM keyed k JOIN recs r USING (case_id) WHERE r.confidence = 'LOW' AND k.pos = 1),
sig AS (SELECT DISTINCT case_id, 'packages' AS family, regexp_replace(fq, '\\.[^.]*$', '') AS token FROM own WHERE side = 0 AND contains(fq, '.')
  UNION SELECT case_id, 'classes', split_part(fq, '.', -1) FROM own UNION SELECT case_id, 'methods', meth FROM own
  UNION SELECT case_id, 'symbols', key FROM own WHERE side = 1 UNION SELECT case_id, 'libraries', so FROM own WHERE side = 1
  UNION SELECT case_id, 'errors', split_part(exception, '.', -1) FROM recs WHERE exception <> '')"""


@query("fault_signals", f"WITH {SIGNAL_SQL} SELECT case_id, family, token FROM sig")
def fault_signals(spark, d):
    return faults.signal_rows(faults.fault_signals(records(spark, d))).select("case_id", "family", "token")


@query("fault_localization", f"""WITH {FRAMES_SQL},
want AS (SELECT user_id AS case_id, arg_min('com.acme.click.p' || (k % 5) || '.Panel' || k || '.onTap', event_id) AS fault_frame,
   arg_min('app/src/Panel' || k || '.java', event_id) AS fault_file FROM ev WHERE event_type = 'click' AND value >= 2 GROUP BY 1),
j AS (SELECT *, string_split(keys, ',') AS ks FROM recs JOIN want USING (case_id))
SELECT count(*) AS n, round(avg((top_frame_key = fault_frame)::INT), 6) AS frame_1,
  round(avg(list_contains(ks[1:5], fault_frame)::INT), 6) AS frame_k,
  round(avg((coalesce(fault_file_hint, '') = split_part(fault_file, '/', -1))::INT), 6) AS file_1,
  count(*) FILTER (WHERE top_frame_key IS NULL) AS no_fault_found FROM j""")
def fault_localization(spark, d):
    e = D.load(spark, d, "events").where("event_type = 'click' AND value >= 2")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    labels = e.groupBy(F.col("user_id").alias("case_id")).agg(
        F.min_by(D.cat("=com.acme.click.p", k % 5, "=.Panel", k, "=.onTap"), "event_id").alias("fault_frame"),
        F.min_by(D.cat("=app/src/Panel", k, "=.java"), "event_id").alias("fault_file"))
    return rounded(grading.fault_localization(records(spark, d), labels))


@query("frame_keys", f"""WITH {LINES_SQL},
f AS (SELECT case_id, line_no, regexp_extract(msg, 'at ([\\w.]+)\\.(\\w+)\\(', 1) AS fq, regexp_extract(msg, 'at ([\\w.]+)\\.(\\w+)\\(', 2) AS m,
  regexp_extract(msg, '(lib\\w+\\.so)', 1) AS so, regexp_extract(msg, '\\(([^+)]+)\\+0x', 1) AS sym FROM lines)
SELECT case_id, line_no, CASE WHEN so <> '' THEN sym ELSE fq || '.' || m END AS frame_key,
  CASE WHEN so <> '' THEN so ELSE regexp_replace(fq, '\\.[^.]*$', '') END AS package_key,
  so = '' AND starts_with(fq, 'android.') AS framework FROM f WHERE so <> '' OR fq <> ''""")
def frame_keys(spark, d):
    rows = faults.parse_lines(log_lines(spark, d)).select("case_id", "line_no", F.explode(L.frames(F.col("msg"))).alias("f"))
    package = F.when(F.col("f.soname") != "", F.col("f.soname")).otherwise(F.col("f.package"))
    return rows.select("case_id", "line_no", L.frame_key(F.col("f")).alias("frame_key"), package.alias("package_key"),
                       L.is_framework(F.col("f")).alias("framework"))


@query("extracted_signals", f"""WITH {RAW_SQL},
c AS (SELECT line_no, raw, regexp_extract(raw, '\\bat ([a-zA-Z_][\\w.]+)\\.([A-Za-z_]\\w*)\\(', 1) AS fq,
  regexp_extract(raw, '\\bat ([a-zA-Z_][\\w.]+)\\.([A-Za-z_]\\w*)\\(', 2) AS m, regexp_extract(raw, '\\b((?:[a-z]\\w*\\.){{2,}}[A-Z]\\w*)', 1) AS cls,
  regexp_extract(raw, '(lib\\w+\\.so)', 1) AS so, regexp_extract(raw, '\\b([A-Z]\\w+(?:Error|Exception))\\b', 1) AS err FROM raws)
SELECT line_no, CASE WHEN fq <> '' THEN fq ELSE cls END AS classes, m AS methods,
  CASE WHEN fq <> '' THEN regexp_replace(fq, '\\.[^.]*$', '') WHEN cls <> '' THEN regexp_replace(cls, '\\.[^.]*$', '') ELSE '' END AS packages,
  so AS libraries, err AS errors FROM c""")
def extracted_signals(spark, d):
    rows = log_lines(spark, d).withColumn("s", L.signals(F.col("raw"), F.lit("")))
    # symbols of native frames are compared in fault_signals
    return rows.select("line_no", *[F.array_join(f"s.{f}", ",").alias(f) for f in ("classes", "methods", "packages", "libraries", "errors")])


@query("bug_kinds", f"""WITH {FRAMES_SQL}
SELECT c_custkey AS case_id, CASE WHEN length(coalesce(top_frame_key, '')) > 0 THEN 'crash' ELSE 'functional' END AS bug_kind
FROM customer LEFT JOIN recs ON case_id = c_custkey""")
def bug_kinds(spark, d):
    keys = records(spark, d).select("case_id", F.col("top_frame_key").alias("fault_frame"))
    cases = D.load(spark, d, "customer").select(F.col("c_custkey").alias("case_id")).join(keys, "case_id", "left")
    return faults.stamp_bug_kind(cases).select("case_id", "bug_kind")


ROUTES_SQL = """routes AS (SELECT DISTINCT 'com.acme.click.p' || (k % 5) AS prefix, 'repo' || (k % 5) AS repo FROM ev
   UNION SELECT DISTINCT 'com.acme', 'repo9' FROM ev),
sonames AS (SELECT DISTINCT 'libcart' || (k % 7) || '.so' AS soname, 'repo' || (k % 7) AS repo FROM ev),
pre AS (SELECT case_id, token, arg_max(repo, length(prefix)) AS repo FROM sig JOIN routes ON token = prefix OR starts_with(token, prefix || '.')
   WHERE family IN ('packages', 'classes') GROUP BY 1, 2),
routed AS (SELECT DISTINCT case_id, repo FROM pre UNION SELECT case_id, repo FROM sig JOIN sonames ON soname = token WHERE family = 'libraries')"""


def route_tables(spark, d):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = D.load(spark, d, "events")
    routes = e.select(D.cat("=com.acme.click.p", k % 5).alias("prefix"), D.cat("=repo", k % 5).alias("repo")).unionByName(
        e.select(F.lit("com.acme").alias("prefix"), F.lit("repo9").alias("repo"))).distinct()
    return routes, e.select(D.cat("=libcart", k % 7, "=.so").alias("soname"), D.cat("=repo", k % 7).alias("repo")).distinct()


def routed_of(spark, d):
    tokens = faults.signal_rows(faults.fault_signals(records(spark, d)))
    return ranking.route_tokens(tokens, *route_tables(spark, d))


@query("routed_repos", f"WITH {SIGNAL_SQL}, {ROUTES_SQL} SELECT case_id, repo FROM routed")
def routed_repos(spark, d):
    return routed_of(spark, d)


BASE_SQL = """base AS (SELECT case_id, repo, coalesce(n, 0) AS score, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(n, 0) DESC, repo) AS rank
  FROM (SELECT DISTINCT user_id AS case_id FROM events) CROSS JOIN (SELECT DISTINCT 'repo' || (k % 8) AS repo FROM ev)
  LEFT JOIN (SELECT user_id AS case_id, 'repo' || (k % 8) AS repo, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1, 2) USING (case_id, repo))"""


def event_base(spark, d):
    """A base ranking of eight repos per user by the number of views."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = D.load(spark, d, "events").withColumn("repo", D.cat("=repo", k % 8))
    cases = e.select(F.col("user_id").alias("case_id")).distinct()
    cands = ranking.candidates(cases, e.select("repo").distinct())
    n = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("case_id"), "repo").agg(F.count("*").cast("double").alias("score"))
    return ranking.rank_scores(ranking.fill_catalog(cands, n))


@query("routing_fusion", f"""WITH {SIGNAL_SQL}, {ROUTES_SQL}, {BASE_SQL},
f AS (SELECT b.case_id, b.repo, CASE WHEN score > 0 THEN 1.0::DOUBLE / (60 + rank - 1) ELSE 0 END + CASE WHEN r.repo IS NULL THEN 0 ELSE 2.0::DOUBLE / 60 END AS s
   FROM base b LEFT JOIN routed r USING (case_id, repo))
SELECT case_id, repo, round(s, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, repo) AS rank FROM f""")
def routing_fusion(spark, d):
    out = ranking.routing_fusion(event_base(spark, d), routed_of(spark, d))
    return out.select("case_id", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


AFF_SQL = """aff AS (SELECT c_mktsegment AS component, 'N' || c_nationkey AS repo, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2)"""


def affinity_cases(spark, d):
    c = D.load(spark, d, "customer")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("component"))
    labels = c.select(F.col("c_custkey").alias("case_id"), D.cat("=N", "c_nationkey").alias("owning_repo"),
                      (F.col("c_acctbal") > 0).alias("is_answerable"))
    return cases, labels


@query("affinity_counts", f"WITH {AFF_SQL} SELECT component, repo, n FROM aff")
def affinity_counts(spark, d):
    return ranking.affinity_counts(*affinity_cases(spark, d))


@query("affinity_weights", f"""WITH {AFF_SQL}
SELECT component, repo, round(n::DOUBLE / sum(n) OVER (PARTITION BY component), 6) AS w FROM aff""")
def affinity_weights(spark, d):
    return rounded(ranking.affinity_weights(ranking.affinity_counts(*affinity_cases(spark, d))))


LOO_SQL = f"""{AFF_SQL}, cs AS (SELECT c_custkey AS case_id, c_mktsegment AS component, 'N' || c_nationkey AS owner FROM customer),
loo AS (SELECT case_id, a.repo, a.n - CASE WHEN a.repo = owner THEN 1 ELSE 0 END AS n FROM cs JOIN aff a USING (component)),
lw AS (SELECT case_id, repo, n::DOUBLE / sum(n) OVER (PARTITION BY case_id) AS w FROM loo WHERE n > 0)"""


@query("affinity_leave_one_out", f"WITH {LOO_SQL} SELECT case_id, repo, round(w, 6) AS w FROM lw")
def affinity_leave_one_out(spark, d):
    return rounded(loo_weights(spark, d))


def loo_weights(spark, d):
    cases, labels = affinity_cases(spark, d)
    counts = ranking.affinity_counts(cases, labels)
    owned = cases.join(labels.select("case_id", F.col("owning_repo").alias("owner")), "case_id")
    return ranking.affinity_leave_one_out(counts, owned)


PRIOR_SQL = """pb AS (SELECT case_id, repo, coalesce(n, 0) AS score, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(n, 0) DESC, repo) AS rank
  FROM (SELECT c_custkey AS case_id FROM customer) CROSS JOIN (SELECT 'N' || n_nationkey AS repo FROM nation)
  LEFT JOIN (SELECT o_custkey AS case_id, 'N' || (o_orderkey % 25) AS repo, count(*) AS n FROM orders GROUP BY 1, 2) USING (case_id, repo)),
pf AS (SELECT p.case_id, p.repo, CASE WHEN score > 0 THEN 1.0::DOUBLE / (60 + rank - 1) ELSE 0 END + coalesce(w, 0) AS s
  FROM pb p LEFT JOIN lw USING (case_id, repo))"""


@query("component_prior", f"""WITH {LOO_SQL}, {PRIOR_SQL}
SELECT case_id, repo, round(s, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, repo) AS rank FROM pf""")
def component_prior(spark, d):
    cases, _ = affinity_cases(spark, d)
    nations = D.load(spark, d, "nation").select(D.cat("=N", "n_nationkey").alias("repo"))
    n = D.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id"), D.cat("=N", F.col("o_orderkey") % 25).alias("repo")).agg(
        F.count("*").cast("double").alias("score"))
    base = ranking.rank_scores(ranking.fill_catalog(ranking.candidates(cases, nations), n))
    out = ranking.component_prior(base, cases, loo_weights(spark, d))
    return out.select("case_id", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


PROSE_SQL = f"""{sql_vec_ranking(50, 'p0')}, {sql_vec_ranking(10, 'g0')},
bonus AS (SELECT case_id, repo, 0.15::DOUBLE / row_number() OVER (PARTITION BY case_id ORDER BY rank) AS b FROM g0 WHERE score > 0),
ps AS (SELECT p.case_id, p.repo, p.score + coalesce(b, 0) AS score FROM p0 p LEFT JOIN bonus USING (case_id, repo)),
pr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, repo) AS rank FROM ps)"""


def prose_of(spark, d):
    hits, cands = vec_hits(spark, d, V.VECTOR_TOP_K)
    logs = ranked(hits, cands, 10)
    return ranking.prose_ranking(hits, cands, logs), logs


@query("prose_ranking", f"WITH {PROSE_SQL} SELECT case_id, repo, round(score, 6) AS score, rank FROM pr")
def prose_ranking(spark, d):
    return prose_of(spark, d)[0].select("case_id", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("dispatched_ranking", f"""WITH {PROSE_SQL},
fl AS (SELECT vec_id AS case_id, coalesce(quality, 0) = 1 AS is_prose FROM embeddings LEFT JOIN labels ON doc_id = vec_id)
SELECT case_id, repo, round(score, 6) AS score, rank FROM pr JOIN fl USING (case_id) WHERE is_prose UNION ALL
SELECT case_id, repo, round(score * 10, 6), rank FROM g0 JOIN fl USING (case_id) WHERE NOT is_prose""")
def dispatched_ranking(spark, d):
    prose, logs = prose_of(spark, d)
    flags = D.load(spark, d, "embeddings").join(D.load(spark, d, "labels"), F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("vec_id").alias("case_id"), (F.coalesce("quality", F.lit(0)) == 1).alias("is_prose"))
    out = ranking.dispatch(flags, prose, logs, 10.0)
    return out.select("case_id", "repo", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("prose_queries", """
SELECT conv_id, turn, trim(regexp_replace(lower(role || ' ' || text), '\\s+', ' ', 'g')) AS prose FROM conversations""")
def prose_queries(spark, d):
    return D.load(spark, d, "conversations").select("conv_id", "turn", T.normalize_prose(F.col("role"), F.col("text")).alias("prose"))


@query("dispatched_signals", f"""WITH {FRAMES_SQL}
SELECT c_custkey AS case_id, r.case_id IS NULL AS is_prose, CASE WHEN r.case_id IS NULL THEN lower(c_name || ' ' || c_mktsegment) ELSE '' END AS prose_query,
  c_mktsegment AS component FROM customer LEFT JOIN recs r ON r.case_id = c_custkey""")
def dispatched_signals(spark, d):
    tickets = D.load(spark, d, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_name").alias("summary"), F.col("c_mktsegment").alias("description"),
        F.col("c_mktsegment").alias("component"), F.lit("").alias("log_text"))
    return faults.dispatch_signals(tickets, records(spark, d)).drop("signals")


ANCHOR_TEXT = """text || ' "quoted ' || doc_id || '" `tick ' || doc_id || '` DocPanel' || doc_id || ' HTTPServer v1.2.3 HTTP lib.name_' || doc_id || ' THE'"""
STOP = ", ".join(f"'{w}'" for w in V.ANCHOR_STOPLIST)


@query("literal_anchors", f"""WITH t AS (SELECT doc_id, {ANCHOR_TEXT} AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_\\p{{M}}]+') AS ws FROM t),
f AS (SELECT doc_id, list_concat(
   list_transform(regexp_extract_all(x, '"[^"]{{2,60}}"|''[^'']{{2,60}}'''), lambda s: [s[2:-2], 'y']),
   list_transform(regexp_extract_all(x, '`([^`]{{2,60}})`', 1), lambda s: [s, 'y']),
   list_transform(list_filter(ws, lambda s: regexp_full_match(s, '[A-Za-z]*[a-z][A-Z][\\p{{L}}\\p{{N}}_\\p{{M}}]*|[A-Z]{{2,}}[a-z][\\p{{L}}\\p{{N}}_\\p{{M}}]*')), lambda s: [s, 'n']),
   list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_\\p{{M}}]+[._][\\p{{L}}\\p{{N}}_\\p{{M}}][\\p{{L}}\\p{{N}}_\\p{{M}}.]*'), lambda s: [rtrim(s, '.'), 'n']),
   list_transform(list_filter(ws, lambda s: regexp_full_match(s, '[A-Z]{{2,5}}')), lambda s: [s, 'n'])) AS c FROM w),
u AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS p FROM f),
k AS (SELECT doc_id, i, regexp_replace(p[1], '^\\s+|\\s+$', '', 'g') AS a, p[2] AS forced FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(a) ORDER BY i) AS rn FROM k WHERE a <> '' AND
   (forced = 'y' OR (lower(a) NOT IN ({STOP}) AND NOT regexp_full_match(a, '(?i)v?\\d+(?:[._]\\d+)*[a-z]{{0,3}}'))))
SELECT doc_id, a AS anchor FROM g WHERE rn = 1""")
def literal_anchors(spark, d):
    docs = spread(D.load(spark, d, "documents"))
    text = D.cat("text", '= "quoted ', "doc_id", '=" `tick ', "doc_id", "=` DocPanel", "doc_id", "= HTTPServer v1.2.3 HTTP lib.name_",
                 "doc_id", "= THE")
    return docs.select("doc_id", F.explode(T.anchor_candidates(text)).alias("anchor"))


@query("crash_site_frames", """
WITH files AS (SELECT o_orderkey AS case_id, o_orderpriority AS repo, u.pos, u.file FROM orders, LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest([
   'app/src/main/java/org/acme/m' || (o_custkey % 97) || '/Panel' || (o_custkey % 13) || '.java', 'app/src/test/java/org/acme/T' || o_orderkey || '.java',
   'jni/cart' || (o_orderkey % 11) || '.cpp', 'docs/readme.md', 'lib/src/main/kotlin/Root' || (o_custkey % 5) || '.kt']) AS file) u),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS rank FROM files WHERE pos IN (0, 2, 4))
SELECT case_id, rank, CASE pos WHEN 0 THEN regexp_extract(file, 'java/(.*)/Panel', 1) ELSE '' END AS package_path,
  regexp_extract(file, '([A-Za-z0-9_]+)\\.[a-z]+$', 1) AS cls,
  coalesce((SELECT arg_min(name, uid) FROM (SELECT p_partkey AS uid, p_brand AS b, 'm' || p_partkey AS name, 'Panel' || (p_size % 13) || '.java' AS base FROM part
     WHERE p_type <> 'PROMO') s WHERE s.base = split_part(file, '/', -1)), '-') AS method, split_part(file, '/', -1) AS filename FROM p""")
def crash_site_frames(spark, d):
    o = D.load(spark, d, "orders")
    paths = F.array(D.cat("=app/src/main/java/org/acme/m", F.col("o_custkey") % 97, "=/Panel", F.col("o_custkey") % 13, "=.java"),
                    D.cat("=app/src/test/java/org/acme/T", "o_orderkey", "=.java"), D.cat("=jni/cart", F.col("o_orderkey") % 11, "=.cpp"),
                    F.lit("docs/readme.md"), D.cat("=lib/src/main/kotlin/Root", F.col("o_custkey") % 5, "=.kt"))
    files = o.select(F.col("o_orderkey").alias("case_id"), F.lit("r").alias("repo"), F.posexplode(paths).alias("pos", "file"))
    symbols = D.load(spark, d, "part").select(
        F.lit("r").alias("repo"), F.col("p_partkey").alias("uid"), D.cat("=m", "p_partkey").alias("name"),
        F.when(F.col("p_type") == "PROMO", "Class").otherwise("Method").alias("label"), D.cat("=x/Panel", F.col("p_size") % 13, "=.java").alias("file"))
    out = faults.crash_frames(files, symbols)
    drawn = F.when(F.col("method").rlike("^m[0-9]+$"), F.col("method")).otherwise("-")
    return out.select("case_id", F.col("rank").cast("long").alias("rank"), F.replace("package", F.lit("."), F.lit("/")).alias("package_path"),
                      "cls", drawn.alias("method"), "filename")


@query("crash_classes", """
WITH c AS (SELECT o_orderkey AS case_id, 'own' || (o_custkey % 3) AS owner, CASE WHEN o_orderstatus = 'F' THEN 'native' ELSE 'java' END AS surface FROM orders),
k AS (SELECT DISTINCT p_size AS ord, 'class' || p_size AS class_name, CASE WHEN p_size % 2 = 0 THEN 'native' ELSE 'java' END AS surface,
   CASE WHEN p_size % 5 = 0 THEN 'own1' END AS sole FROM part),
o AS (SELECT owner, surface, list(class_name ORDER BY ord) AS opts FROM (SELECT DISTINCT owner, surface FROM c) JOIN k USING (surface)
   WHERE sole IS NULL OR sole = owner GROUP BY 1, 2)
SELECT case_id, opts[1 + CAST(('0x' || substr(sha1(case_id::VARCHAR), 1, 16))::UBIGINT % len(opts) AS INTEGER)] AS class_name FROM c JOIN o USING (owner, surface)""")
def crash_classes(spark, d):
    o = D.load(spark, d, "orders")
    cases = o.select(F.col("o_orderkey").alias("case_id"), D.cat("=own", F.col("o_custkey") % 3).alias("owner"),
                     F.when(F.col("o_orderstatus") == "F", "native").otherwise("java").alias("surface"))
    size = F.col("p_size")
    classes = D.load(spark, d, "part").select(size.alias("ord"), D.cat("=class", size).alias("class_name"),
                                              F.when(size % 2 == 0, "native").otherwise("java").alias("surface"),
                                              F.when(size % 5 == 0, F.array(F.lit("own1"))).alias("affinity")).distinct()
    return faults.pick_class(cases, classes)
