"""Registered queries: issue splitting, mining filters, scrubbing, leak flags and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import diffs as X
from faultlens.functions import logs as L
from faultlens.functions import text as T
from faultlens.operators import faults, mining
from faultlens.plans import tables as D
from faultlens.plans.lexical_queries import MEMBER_SQL

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def nl(*parts):
    """Join pieces with newlines."""
    out = []
    for p in parts:
        out += [F.lit("\n"), p]
    return F.concat(*out[1:])


def issues(spark, d):
    """Every conversation turn as an issue with log fences or raw log lines, changed files and a fix."""
    c = D.load(spark, d, "conversations")
    role, conv, turn = F.col("role"), F.col("conv_id"), F.col("turn")
    user = nl(F.col("text"), F.lit("```"), D.cat("=java.lang.IllegalStateException: bad ", turn),
              D.cat("=    at com.acme.", role, "=.Panel", conv, "=.open(Panel", conv, "=.java:", turn + 10, "=)"), F.lit("```"),
              F.lit("## Steps"), F.lit("- [x] done"), F.lit('saw computeWidth and log.warn("wide panel seen again"); here'))
    raw = F.lit("01-02 03:04:05.678  12  34 E App: boom libc.so")
    own = D.cat("=01-02 03:04:05.679  12  34 E App: boom libacme", role, "=.so")
    other = F.lit("01-02 03:04:05.680  12  34 E App: boom libother.so")
    many = nl(F.col("text"), raw, own, raw, raw, F.lit("tail"))
    two = nl(F.col("text"), raw, own, F.lit("tail"), raw)
    strange = nl(F.col("text"), raw, other, raw, F.lit("tail"))
    body = (F.when((role == "user") & (turn != 4), user).when((role == "assistant") & (turn == 1), two)
            .when((role == "assistant") & (turn == 5), strange).when(role == "assistant", many).otherwise(F.col("text")))
    main = D.cat("=app/src/main/java/com/acme/", role, "=/Panel", conv, "=.java")
    pair = lambda name, status: F.struct(name.alias("filename"), F.lit(status).alias("status"))
    tests = pair(D.cat("=app/src/test/java/com/acme/Panel", conv, "=Test.java"), "added")
    readme = pair(F.lit("README.md"), "modified")
    files = F.when(turn == 3, F.array(readme)).otherwise(F.array(pair(main, "modified"), tests, readme))
    patch = nl(D.cat("=diff --git a/", main, "= b/", main), D.cat("=--- a/", main), D.cat("=+++ b/", main), F.lit("@@ -1 +1 @@"),
               F.lit("+    int panelWidth = computeWidth(view);"), F.lit("+    // see note("), F.lit("+"),
               D.cat("=+    render", turn, "=(panelWidth, 12);"), F.lit('+    log.warn("wide panel seen again");'), F.lit("-    gone();"), F.lit(""))
    return c.select(
        D.cat("=acme/", role).alias("slug"), (conv * 100 + turn).alias("number"),
        F.when(role == "system", D.cat("=Merge branch ", turn)).otherwise(D.cat("=Panel", conv, "= breaks")).alias("title"),
        body.alias("body"), files.alias("files"), F.size(files).alias("files_total"), patch.alias("fix_patch"),
        F.sha1(D.cat(role, "=#", conv, "=#", turn)).alias("merge_sha"), D.cat("=2024-01-0", turn + 1).alias("merged_at"),
        D.cat("=acme-", role).alias("owner"), F.array(D.cat("=com.acme.", role)).alias("owner_namespaces"),
        F.array(D.cat("=acme-", role)).alias("owner_slugs"),
        F.array(D.cat("=libacme", role, "=.so"), F.lit("libc.so")).alias("owner_sonames"),
        D.cat("=AcmeTeam/", role).alias("github_slug"), "role", "conv_id", "turn")


RAW = "'01-02 03:04:05.678  12  34 E App: boom libc.so'"
NL = " || chr(10) || "
ISSUE_SQL = f"""iss AS (SELECT *, 'acme/' || role AS slug, conv_id * 100 + turn AS number, 'acme-' || role AS owner,
  CASE WHEN role = 'system' THEN 'Merge branch ' || turn ELSE 'Panel' || conv_id || ' breaks' END AS title,
  'app/src/main/java/com/acme/' || role || '/Panel' || conv_id || '.java' AS main, '2024-01-0' || (turn + 1) AS merged_at,
  CASE WHEN role = 'user' AND turn <> 4 THEN text{NL}'```'{NL}'java.lang.IllegalStateException: bad ' || turn{NL}
      '    at com.acme.' || role || '.Panel' || conv_id || '.open(Panel' || conv_id || '.java:' || (turn + 10) || ')'{NL}'```'{NL}
      '## Steps'{NL}'- [x] done'{NL}'saw computeWidth and log.warn("wide panel seen again"); here'
    WHEN role = 'assistant' AND turn = 1 THEN text{NL}{RAW}{NL}'01-02 03:04:05.679  12  34 E App: boom libacme' || role || '.so'{NL}'tail'{NL}{RAW}
    WHEN role = 'assistant' AND turn = 5 THEN text{NL}{RAW}{NL}'01-02 03:04:05.680  12  34 E App: boom libother.so'{NL}{RAW}{NL}'tail'
    WHEN role = 'assistant' THEN text{NL}{RAW}{NL}'01-02 03:04:05.679  12  34 E App: boom libacme' || role || '.so'{NL}{RAW}{NL}{RAW}{NL}'tail'
    ELSE text END AS body FROM conversations),
pat AS (SELECT *, 'diff --git a/' || main || ' b/' || main{NL}'--- a/' || main{NL}'+++ b/' || main{NL}'@@ -1 +1 @@'{NL}
   '+    int panelWidth = computeWidth(view);'{NL}'+    // see note('{NL}'+'{NL}'+    render' || turn || '(panelWidth, 12);'{NL}
   '+    log.warn("wide panel seen again");'{NL}'-    gone();'{NL}'' AS fix_patch FROM iss)"""


@query("issue_ids", f"""WITH {ISSUE_SQL}
SELECT slug, number, 'gl-' || substr(sha1(slug || '#' || number), 1, 12) AS case_id FROM iss""")
def issue_ids(spark, d):
    return issues(spark, d).select("slug", "number", T.opaque_id(F.col("slug"), F.col("number")).alias("case_id"))


def sql_any(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(col, p.replace("(?U)", "").replace("(?Um)", "(?m)").replace("'", "''"))
                             for p in patterns) + ")"


def sql_kind(col: str) -> str:
    return (f"CASE WHEN {sql_any(col, L.BLOCK_NATIVE)} THEN 'native' WHEN {sql_any(col, L.BLOCK_ANR)} THEN 'anr' "
            f"WHEN {sql_any(col, L.BLOCK_LOGCAT)} THEN 'logcat' WHEN {sql_any(col, [L.BLOCK_FRAME, L.BLOCK_EXCEPTION])} THEN 'stacktrace' "
            "ELSE 'other' END")


@query("body_kinds", f"WITH {ISSUE_SQL} SELECT slug, number, {sql_kind('body')} AS kind, {sql_any('body', L.CRASH)} AS crash FROM iss")
def body_kinds(spark, d):
    return issues(spark, d).select("slug", "number", L.classify_block(F.col("body")).alias("kind"),
                                   L.has_crash_signature(F.col("body")).alias("crash"))


RUNS_SQL = f"""li AS (SELECT slug, number, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos, unnest(string_split(body, chr(10))) AS line FROM iss),
lg AS (SELECT *, {sql_any('line', L.LOG_LINE)} AS is_log FROM li),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY slug, number ORDER BY pos) AS run FROM lg WHERE is_log),
runs AS (SELECT slug, number, CAST(min(pos) AS INTEGER) AS start, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS t
   FROM isl GROUP BY slug, number, run HAVING count(*) >= 3)"""


@query("unfenced_log_runs", f"WITH {ISSUE_SQL}, {RUNS_SQL} SELECT slug, number, start, n_lines, {sql_kind('t')} AS kind, md5(t) AS text_md5 FROM runs")
def unfenced_log_runs(spark, d):
    raw = issues(spark, d).select(F.struct("slug", "number").alias("id"), F.col("body").alias("text"))
    return faults.unfenced_runs(raw).select("id.slug", "id.number", "start", "n_lines", "kind", F.md5("text").alias("text_md5"))


SPLIT_SQL = f"""sp AS (SELECT slug, number, role, turn, conv_id, title, main, merged_at, owner,
  regexp_replace(CASE WHEN role = 'user' AND turn <> 4 THEN text{NL}''{NL}''{NL}'saw computeWidth and log.warn("wide panel seen again"); here'
    WHEN role = 'assistant' AND turn = 1 THEN body WHEN role = 'assistant' THEN text{NL}'tail' ELSE text END, '^\\s+|\\s+$', '', 'g') AS prose,
  CASE WHEN role = 'user' AND turn <> 4 THEN 'java.lang.IllegalStateException: bad ' || turn{NL}
      '    at com.acme.' || role || '.Panel' || conv_id || '.open(Panel' || conv_id || '.java:' || (turn + 10) || ')'
    WHEN role = 'assistant' AND turn <> 1 THEN (SELECT t FROM runs r WHERE r.slug = iss.slug AND r.number = iss.number) ELSE '' END AS log
  FROM iss)"""


@query("split_issue_bodies", f"WITH {ISSUE_SQL}, {RUNS_SQL}, {SPLIT_SQL} SELECT slug, number, md5(prose) AS prose_md5, md5(log) AS log_md5 FROM sp")
def split_issue_bodies(spark, d):
    parts = faults.split_bodies(issues(spark, d).select(F.struct("slug", "number").alias("id"), "body"))
    return parts.select("id.slug", "id.number", F.md5("prose").alias("prose_md5"),
                        F.md5(F.array_join(F.transform("logs", lambda g: g["text"]), "\n")).alias("log_md5"))


@query("production_files", f"""WITH {ISSUE_SQL}
SELECT slug, number, CASE WHEN turn = 3 THEN '' ELSE main END AS files, turn <> 3 AND role <> 'system' AS minable,
  {sql_any('body', L.CRASH)} AND turn <> 3 AS admitted FROM iss""")
def production_files(spark, d):
    i = issues(spark, d)
    ok = mining.is_minable(F.lit(True), F.col("title"), F.col("files_total"), F.col("files"))
    gate = mining.admit_e2e(F.col("body"), F.col("merge_sha"), F.col("files"), True, True)
    return i.select("slug", "number", F.array_join(mining.production_files(F.col("files")), ",").alias("files"), ok.alias("minable"),
                    gate.alias("admitted"))


@query("required_apis", f"""WITH {ISSUE_SQL} SELECT slug, number, 'computeWidth,render' || turn || ',warn' AS apis FROM iss""")
def required_apis(spark, d):
    return issues(spark, d).select("slug", "number", F.array_join(X.required_apis(F.col("fix_patch"), 5), ",").alias("apis"))


@query("diff_fields", f"""WITH {ISSUE_SQL},
ln AS (SELECT slug, number, generate_subscripts(string_split(fix_patch, chr(10)), 1) AS i, unnest(string_split(fix_patch, chr(10))) AS s FROM pat),
ad AS (SELECT slug, number, i, substr(s, 2) AS s FROM ln WHERE starts_with(s, '+') AND NOT starts_with(s, '+++'))
SELECT p.slug, p.number, regexp_replace(substr(h.s, 5), '^[ab]/', '') AS touched,
  (SELECT count(*) FROM ad a WHERE a.slug = p.slug AND a.number = p.number) AS n_added,
  (SELECT count(*) FROM ad a WHERE a.slug = p.slug AND a.number = p.number AND trim(s) <> '' AND NOT regexp_matches(trim(s), '^(//|#|\\*|/\\*)')) AS n_code,
  true AS uses_width, false AS uses_note_in_code, true AS uses_note FROM pat p JOIN ln h ON h.slug = p.slug AND h.number = p.number AND starts_with(h.s, '+++ ')""")
def diff_fields(spark, d):
    p = F.col("fix_patch")
    return issues(spark, d).select(
        "slug", "number", F.array_join(X.touched_files(p), ",").alias("touched"), F.size(X.added_lines(p)).cast("long").alias("n_added"),
        F.size(X.code_added_lines(p)).cast("long").alias("n_code"), X.references_api(p, F.lit("computeWidth")).alias("uses_width"),
        X.references_api_code(p, F.lit("note")).alias("uses_note_in_code"), X.references_api(p, F.lit("note")).alias("uses_note"))


@query("diffs_from_replies", f"""WITH {ISSUE_SQL} SELECT slug, number, md5(regexp_replace(fix_patch, '\\n+$', '')) AS diff_md5 FROM pat""")
def diffs_from_replies(spark, d):
    reply = F.when(F.col("turn") % 2 == 0, nl(F.lit("before"), F.lit("```java"), F.lit("int x;"), F.lit("```"), F.lit("then"),
                                              F.concat(F.lit("```diff\n"), F.regexp_replace("fix_patch", "\n\\z", ""), F.lit("\n```")), F.lit("done"))
                   ).otherwise(nl(F.lit("plain words"), F.col("fix_patch")))
    return issues(spark, d).select("slug", "number", F.md5(X.unified_diff(reply)).alias("diff_md5"))


@query("assembled_diffs", f"""WITH {ISSUE_SQL}
SELECT slug, number, md5(CASE WHEN turn % 3 = 0 THEN '' ELSE
  'diff --git a/old/' || main || ' b/' || main{NL}(CASE WHEN turn % 3 = 1 THEN '--- /dev/null' ELSE '--- a/old/' || main END){NL}'+++ b/' || main{NL}
  '@@ -1 +1 @@'{NL}'+x' || turn || chr(10) END) AS diff_md5 FROM iss""")
def assembled_diffs(spark, d):
    main = D.cat("=app/src/main/java/com/acme/", "role", "=/Panel", "conv_id", "=.java")
    turn = F.col("turn")
    one = F.struct(main.alias("filename"), D.cat("=old/", main).alias("previous_filename"),
                   F.when(turn % 3 == 1, "added").otherwise("modified").alias("status"),
                   F.when(turn % 3 != 0, D.cat("=@@ -1 +1 @@\n+x", turn, "=\n\n")).alias("patch"))
    return issues(spark, d).select("slug", "number", F.md5(X.assemble_diff(F.array(one))).alias("diff_md5"))


@query("patch_shingles", f"""WITH {ISSUE_SQL},
l AS (SELECT slug, number, unnest([1, 2, 3, 4]) AS i, unnest(['int panelWidth = computeWidth(view);', '// see note(',
   'render' || turn || '(panelWidth, 12);', 'log.warn("wide panel seen again");']) AS s FROM iss),
g AS (SELECT slug, number, s FROM l UNION SELECT a.slug, a.number, a.s || ' ' || b.s FROM l a JOIN l b ON b.slug = a.slug AND b.number = a.number AND b.i = a.i + 1
  UNION SELECT a.slug, a.number, a.s || ' ' || b.s || ' ' || c.s FROM l a JOIN l b ON b.slug = a.slug AND b.number = a.number AND b.i = a.i + 1
   JOIN l c ON c.slug = a.slug AND c.number = a.number AND c.i = a.i + 2)
SELECT DISTINCT slug, number, s AS shingle FROM g WHERE length(s) >= 24""")
def patch_shingles(spark, d):
    return issues(spark, d).select("slug", "number", F.explode(X.shingles(F.col("fix_patch"))).alias("shingle"))


SCRUB_SQL = f"""{ISSUE_SQL}, {RUNS_SQL}, {SPLIT_SQL},
tx AS (SELECT slug, number, role, turn, conv_id, main, merged_at, owner, unnest(['prose', 'title', 'log']) AS field, unnest([prose, title, log]) AS t FROM sp
   WHERE turn <> 3 AND role <> 'system'),
s1 AS (SELECT *, regexp_replace(t, '\\bL?(?:com\\.acme\\.' || role || '|com/acme/' || role || ')(?:[./][A-Za-z_$][\\w$]*)*;?', '<REDACTED_PKG>', 'g') AS a FROM tx),
s2 AS (SELECT *, regexp_replace(a, '\\([A-Za-z_$][\\w$]*\\.(?:java|kt|kts|scala|cpp|cc|cxx|c|h|hpp|mm|so):\\d+\\)', '(<REDACTED_SRC>)', 'g') AS b FROM s1),
s3 AS (SELECT *, regexp_replace(b, '(?i)\\blibacme' || role || '\\.so\\b|\\blibacme' || role || '\\b', '<REDACTED_SO>', 'g') AS c FROM s2),
s4 AS (SELECT *, regexp_replace(regexp_replace(c, '\\b' || replace(main, '.', '\\.') || '\\b', '<REDACTED_PATH>', 'g'), '\\bPanel' || conv_id || '\\b', '<REDACTED_PATH>', 'g') AS e FROM s3),
s5 AS (SELECT *, regexp_replace(regexp_replace(e, '\\bcomputeWidth\\b', '<REDACTED_METHOD>', 'g'), '\\bpanelWidth\\b', '<REDACTED_METHOD>', 'g') AS f FROM s4),
s6 AS (SELECT *, regexp_replace(regexp_replace(f, '(?i)\\bacme-' || role || '\\b', '<REDACTED_REPO>', 'g'), '(?i)\\bAcmeTeam\\b', '<REDACTED_REPO>', 'g') AS h FROM s5),
s7 AS (SELECT *, replace(h, 'log.warn("wide panel seen again");', '<REDACTED_PATCH>') AS clean FROM s6)"""


def live_issues(spark, d):
    i = issues(spark, d).withColumns({"expected_files": mining.production_files(F.col("files")), "id": F.struct("slug", "number")})
    i = i.where(mining.is_minable(F.lit(True), F.col("title"), F.col("files_total"), F.col("files")))
    parts = faults.split_bodies(i.select("id", "body"))
    return mining.scrubbed(mining.with_owner_tokens(i.join(parts, "id")), ["prose", "title"], "logs")


@query("scrubbed_texts", f"WITH {SCRUB_SQL} SELECT slug, number, field, clean AS text FROM s7")
def scrubbed_texts(spark, d):
    rows = live_issues(spark, d)
    log = F.array_join(F.transform("logs", lambda g: g["text"]), "\n")
    return rows.select("slug", "number", F.explode(F.array(
        F.struct(F.lit("prose").alias("field"), F.col("prose").alias("text")), F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
        F.struct(F.lit("log").alias("field"), log.alias("text")))).alias("r")).select("slug", "number", "r.*")


FLAG_SQL = f"""{SCRUB_SQL},
al AS (SELECT slug, number, role, turn, conv_id, main, merged_at, owner, string_agg(clean, chr(10)) AS t FROM s7 GROUP BY ALL),
fl AS (SELECT *, regexp_matches(t, '(?i)\\b(?:acme-' || role || '|AcmeTeam)\\b') AS reponame_in_text,
  regexp_matches(t, 'com[./]acme[./]' || role) AS package_in_text, regexp_matches(t, '\\bPanel' || conv_id || '\\b') AS file_in_text,
  regexp_matches(t, '(?i)\\blibacme' || role || '\\b') AS so_in_text, contains(t, 'log.warn("wide panel') AS patch_in_text,
  len(list_filter(regexp_extract_all(t, '\\blib\\w+\\.so\\b'), lambda s: s NOT IN ('libc.so', 'libacme' || role || '.so'))) > 0 AS unknown_so_in_text,
  len(regexp_extract_all(t, '\\b[A-Z]\\w+(?:Error|Exception)\\b')) + len(regexp_extract_all(t, 'lib\\w+\\.so')) > 0 AS left_over FROM al),
vd AS (SELECT *, CASE WHEN reponame_in_text OR package_in_text OR file_in_text OR so_in_text OR patch_in_text OR unknown_so_in_text THEN 'REJECT'
   WHEN left_over THEN 'ADMIT' ELSE 'BUCKET_PROSE_ONLY' END AS verdict FROM fl)"""


@query("leak_flags", f"""WITH {FLAG_SQL} SELECT slug, number, reponame_in_text, package_in_text, file_in_text, false AS class_in_text, so_in_text,
  patch_in_text, unknown_so_in_text, false AS extractor_leak, verdict FROM vd""")
def leak_flags(spark, d):
    rows = live_issues(spark, d).withColumn("described", F.concat("prose", F.lit("\n"), "title"))
    return mining.with_verdict(rows, "described", "logs", "owner").select("slug", "number", *mining.FLAGS, "verdict")


OUTCOME_SQL = f"""{FLAG_SQL},
ans AS (SELECT *, row_number() OVER (ORDER BY slug, number) AS seq FROM vd WHERE verdict = 'ADMIT'),
oc AS (SELECT slug, number, 'dropped_filters' AS outcome, NULL AS negative_class FROM iss WHERE turn = 3 OR role = 'system'
  UNION ALL SELECT slug, number, CASE verdict WHEN 'REJECT' THEN 'rejected_leak' ELSE 'bucketed' END,
     CASE verdict WHEN 'REJECT' THEN NULL ELSE 'insufficient_signal' END FROM vd WHERE verdict <> 'ADMIT'
  UNION ALL SELECT slug, number, CASE WHEN merged_at > '2024-01-06' THEN 'coverage_gap' WHEN seq % 4 = 0 THEN 'oof' ELSE 'admitted' END,
     CASE WHEN merged_at > '2024-01-06' THEN 'coverage_gap' WHEN seq % 4 = 0 THEN 'out_of_fleet' END FROM ans)"""


def outcomes_of(spark, d):
    return mining.outcomes(issues(spark, d).drop("role", "conv_id", "turn"), holdout_frac=0.25, coverage_cutoff="2024-01-06")


@query("mining_outcomes", f"WITH {OUTCOME_SQL} SELECT slug, number, outcome, negative_class FROM oc")
def mining_outcomes(spark, d):
    return outcomes_of(spark, d)


@query("mining_report", f"WITH {OUTCOME_SQL} SELECT outcome, count(*) AS n FROM oc GROUP BY 1")
def mining_report(spark, d):
    return mining.report(outcomes_of(spark, d))


@query("held_out_rows", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) % 5 = 0 AS held_out FROM orders""")
def held_out_rows(spark, d):
    o = D.load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return mining.hold_out(o, [F.col("o_orderdate"), F.col("o_orderkey")], 0.2).select("o_orderkey", "held_out")


@query("owner_still_wins", MEMBER_SQL + """
SELECT case_id FROM ranked WHERE rank = 1 AND score > 0 AND repo = 'src' || (case_id % 20)""")
def owner_still_wins(spark, d):
    # the code tokens of a benchmark item are its words written as class names, read back by the extractor
    b = D.load(spark, d, "benchmark")
    words = F.transform(T.query_terms(F.col("text")), lambda w: F.concat(F.lit("at q."), w, F.lit(".x(")))
    cases = b.select(F.col("item_id").alias("case_id"), D.cat("=src", F.col("item_id") % 20).alias("owner"), F.lit("").alias("description"),
                     F.array_join(words, "\n").alias("log_text"))
    return mining.owner_still_wins(D.units(spark, d), cases, D.catalog(spark, d))


NODE_LABELS = ["Bug", "Enhancement", "question"]


def issue_nodes(spark, d):
    i = issues(spark, d)
    turn, slug = F.col("turn"), F.col("slug")
    files = F.transform("files", lambda f: F.struct(f["filename"].alias("path"), F.when(
        f["status"] == "added", "ADDED").otherwise("DELETED").alias("change_type")))
    def pr(offset, merged, repo):
        return F.struct((F.col("number") * 10 + offset).alias("number"), merged.alias("merged"), F.col("merged_at"), F.col("merge_sha"),
                        repo.alias("repo"), F.lit(None).cast("int").alias("files_total"), files.alias("files"))
    prs = F.array(pr(1, F.lit(True), F.lit("other/fork")), pr(2, turn % 2 == 0, slug), pr(3, turn % 3 == 0, slug))
    labels = F.array(F.get(F.array(*[F.lit(x) for x in NODE_LABELS]), (F.col("conv_id") % 3).cast("int")))
    return i.select("slug", (F.col("number") % 700).alias("seq"), "number", "title", "body", F.lit("u").alias("url"),
                    F.lit("2024").alias("created_at"), labels.alias("labels"), prs.alias("prs"))


@query("harvested_candidates", f"""WITH {ISSUE_SQL}
SELECT slug, number, number * 10 + CASE WHEN turn % 2 = 0 THEN 2 ELSE 3 END AS pr_number, CASE WHEN turn = 3 THEN 1 ELSE 3 END AS files_total,
  CASE WHEN turn = 3 THEN 'README.md:removed' ELSE main || ':removed,app/src/test/java/com/acme/Panel' || conv_id || 'Test.java:added,README.md:removed' END AS files
FROM iss WHERE turn % 2 = 0 OR turn % 3 = 0""")
def harvested_candidates(spark, d):
    c = mining.candidates(issue_nodes(spark, d))
    return c.select("slug", "number", "pr_number", "files_total", F.array_join(
        F.transform("files", lambda f: F.concat(f["filename"], F.lit(":"), f["status"])), ",").alias("files"))


@query("harvested_nondefects", f"""WITH {ISSUE_SQL}
SELECT slug, number, title FROM iss WHERE NOT (turn % 2 = 0 OR turn % 3 = 0) AND conv_id % 3 <> 0""")
def harvested_nondefects(spark, d):
    return mining.nondefects(issue_nodes(spark, d)).select("slug", "number", "title")


@query("authored_case_problems", f"""WITH {ISSUE_SQL},
c AS (SELECT number AS case_id, role, conv_id, turn, main FROM iss),
p AS (SELECT case_id, 'expected_file not found in real source: acme-' || role || '/' || main AS problem FROM c WHERE turn % 4 = 3
 UNION ALL SELECT case_id, 'required_api not found in real source: computeWidth' FROM c WHERE turn % 4 = 3 OR role = 'assistant'
 UNION ALL SELECT case_id, 'crash log names no oracle symbol (ungrounded)' FROM c WHERE role = 'assistant'
 UNION ALL SELECT case_id, 'owning_repo name leaks into the ticket: acme-' || role FROM c WHERE turn % 5 = 0
 UNION ALL SELECT case_id, 'fix.diff does not touch any expected_file' FROM c WHERE turn % 3 = 2)
SELECT case_id, problem FROM p""")
def authored_case_problems(spark, d):
    i = issues(spark, d)
    role, turn = F.col("role"), F.col("turn")
    main = D.cat("=app/src/main/java/com/acme/", role, "=/Panel", "conv_id", "=.java")
    log = F.when(role == "assistant", F.lit("nothing")).otherwise(F.lit("boom in computeWidth"))
    summary = F.when(turn % 5 == 0, D.cat("=seen in ACME_", role)).otherwise(F.lit("seen"))
    diff = F.when(turn % 3 == 2, F.regexp_replace("fix_patch", r"Panel\d+\.java", "Other.kt")).otherwise(F.col("fix_patch"))
    cases = i.select(F.col("number").alias("case_id"), F.lit("t").alias("ticket_id"), summary.alias("summary"), F.lit("").alias("description"),
                     log.alias("log_text"), F.col("owner").alias("owning_repo"), F.array(main).alias("expected_files"),
                     F.array(F.lit("computeWidth")).alias("required_apis"), diff.alias("fix_diff"))
    files = i.where(turn % 4 != 3).select(F.col("owner").alias("repo"), main.alias("path"), F.when(
        role == "assistant", "empty").otherwise("void computeWidth() {}").alias("text"), "number")
    return authored(cases, files)


def authored(cases, files):
    """Give every case its own file so that presence varies per case."""
    named = files.select(F.concat("repo", F.lit("|"), F.col("number").cast("string")).alias("repo"), "path", "text")
    keyed = cases.withColumn("owning_repo", F.concat("owning_repo", F.lit("|"), F.col("case_id").cast("string")))
    problems = mining.validate_authored(keyed.withColumn("summary", F.when(
        F.col("summary") == "seen", F.lit("seen")).otherwise(F.lower(F.col("owning_repo")))), named)
    return problems.withColumn("problem", F.regexp_replace("problem", r"\|\d+", ""))


@query("identifiers_in_source", """
WITH idents AS (SELECT DISTINCT source AS repo, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM documents),
names AS (SELECT DISTINCT 'src' || (conv_id % 20) AS repo, role || '::' || unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM conversations)
SELECT repo, name, EXISTS (SELECT 1 FROM idents i WHERE i.repo = n.repo AND i.ident = split_part(name, '::', -1)) AS "exists" FROM names n""")
def identifiers_in_source(spark, d):
    docs = D.load(spark, d, "documents").select(F.col("source").alias("repo"), "text")
    turns = D.load(spark, d, "conversations").withColumn("word", F.explode(T.matches(F.col("text"), "[A-Za-z]+")))
    names = turns.select(D.cat("=src", F.col("conv_id") % 20).alias("repo"), D.cat(
        "role", "=::", "word").alias("name")).distinct()
    return mining.identifiers_exist(mining.identifier_table(docs), names)


@query("paths_normalised", """
WITH p AS (SELECT p_partkey, ['a/', 'b/', './', '', 'a/./'][1 + p_partkey % 5] || ['app/src/main/java/', 'src/java/', 'lib//src/', 'java/', 'docs/'][1 + p_size % 5]
   || 'x/' || replace(p_name, ' ', '/') || ['.java', '.kt', '.py', '.tsx', '.md'][1 + p_partkey % 5] AS path FROM part),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(path, '^[ab]/', ''), '^\\./', ''), '/+', '/', 'g') AS norm FROM p)
SELECT p_partkey, norm, CASE WHEN contains(norm, '/src/main/java/') THEN regexp_replace(norm, '^.*?/src/main/java/', '')
  WHEN starts_with(norm, 'src/java/') THEN substr(norm, 10) WHEN contains(norm, '/src/') THEN regexp_replace(norm, '^.*?/src/', '')
  WHEN starts_with(norm, 'java/') THEN substr(norm, 6) ELSE norm END AS canonical,
  replace(regexp_replace(norm, '\\.(java|kt|py|tsx)$', ''), '/', '.') AS module,
  CASE WHEN norm LIKE '%.java' THEN 'java' WHEN norm LIKE '%.kt' THEN 'kotlin' WHEN norm LIKE '%.py' THEN 'python' WHEN norm LIKE '%.tsx' THEN 'typescript' END AS lang
FROM n""")
def paths_normalised(spark, d):
    p = D.load(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda vals, at: F.get(F.array(*[F.lit(v) for v in vals]), (at % 5).cast("int"))
    path = F.concat(pick(["a/", "b/", "./", "", "a/./"], key), pick(["app/src/main/java/", "src/java/", "lib//src/", "java/", "docs/"], size),
                    F.lit("x/"), F.replace("p_name", F.lit(" "), F.lit("/")), pick([".java", ".kt", ".py", ".tsx", ".md"], key))
    norm = T.norm_path(path)
    return p.select("p_partkey", norm.alias("norm"), T.canonical_path(path).alias("canonical"), T.module_path(norm).alias("module"),
                    T.language_of(norm).alias("lang"))
