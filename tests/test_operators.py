import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens import session
from faultlens.functions import diffs as X
from faultlens.operators import context, faults, fusion, grading, graph, lexical, matching, mining, ranking, rules, vectors

UNIT = "uid string, repo string, kind string, name string, qualified_name string, file string, text string"


@pytest.fixture(scope="module")
def units(spark):
    rows = [("u1", "r1", "symbol", "ScreenshotUtils", "org.a.ScreenshotUtils", "a/S.java", "save png now"),
            ("u2", "r1", "symbol", "Player", "org.a.Player", "a/P.java", "play png audio audio"),
            ("u3", "r2", "symbol", "Decoder", "org.b.Decoder", "b/D.java", "decode audio stream"),
            ("u4", "r2", "doc", "Audio guide", None, "guide.md", "audio audio audio guide"),
            ("u5", "r3", "symbol", "Other", "org.c.Other", "c/O.java", "nothing here")]
    return spark.createDataFrame(rows, UNIT)


def bm25_by_hand(rows, terms):
    docs = {r.uid: " ".join(x for x in (r.name, r.qualified_name, r.text) if x).lower().replace(".", " ").split() for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for t in terms:
        df = sum(t in d for d in docs.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
        if df and math.log((n - df + 0.5) / (df + 0.5)) <= 0:
            idf = 1e-6
        for uid, d in docs.items():
            f = d.count(t)
            if f:
                out[uid] = out.get(uid, 0) - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg))
    return out


def test_bm25_matches_hand_computed_scores(spark, units):
    q = spark.createDataFrame([("q", "audio png")], "qid string, query string")
    got = {r.uid: r.score for r in lexical.search(units, q, 10).collect()}
    want = bm25_by_hand(units.collect(), ["audio", "png"])
    assert got.keys() == want.keys()
    assert all(abs(got[u] - want[u]) < 1e-8 for u in want)


def test_filters_apply_after_scoring(spark, units):
    q = spark.createDataFrame([("q", "audio")], "qid string, query string")
    every = {r.uid: r.score for r in lexical.search(units, q, 10).collect()}
    some = {r.uid: r.score for r in lexical.search(units, q, 10, repos=["r2"], kinds=["symbol"]).collect()}
    assert some == {"u3": every["u3"]}
    assert lexical.search(units, spark.createDataFrame([("q", "!!")], "qid string, query string")).count() == 0


def test_salted_search_equals_broadcast_search(spark, units, monkeypatch):
    q = spark.createDataFrame([("q1", "audio png"), ("q2", "screenshot save")], "qid string, query string")
    plain = sorted(map(tuple, lexical.search(units, q, 10).collect()))
    for mod in (session, lexical):
        monkeypatch.setattr(mod, "small", lambda df, n=0: False)
    assert sorted(map(tuple, lexical.search(units, q, 10).collect())) == plain


def test_membership_keeps_zero_repos_and_catalog_order(spark, units):
    tokens = spark.createDataFrame([("c", "audio"), ("c", "png"), ("c", "zzz")], "case_id string, token string")
    cands = ranking.candidates(spark.createDataFrame([("c",)], "case_id string"), spark.createDataFrame([("r3", 0), ("r2", 1), ("r1", 2)], "repo string, pos int"))
    rows = ranking.membership(units, tokens, cands).orderBy("rank").collect()
    assert [(r.repo, r.score) for r in rows] == [("r1", 2.0), ("r2", 1.0), ("r3", 0.0)]
    assert rows[0].evidence == ["audio", "png"]


def test_prefix_overlap_cases(spark):
    tokens = spark.createDataFrame([("c", "org.demo.native.Handler"), ("c", "org.oth"), ("c", "xlibs")], "case_id string, token string")
    d = spark.createDataFrame([("a", "org.demo"), ("b", "org.other.x"), ("e", "lib.z"), ("f", "nope")], "repo string, entry string")
    cands = ranking.candidates(tokens.select("case_id").distinct(), d.select("repo"))
    got = {r.repo: int(r.score) for r in ranking.prefix_overlap(tokens, d, cands).collect()}

    def hit(t, e):
        return t == e or t.startswith(e + ".") or e.startswith(t) or e.split(".")[0] in t
    want = {r.repo: sum(hit(t.token, r.entry) for t in tokens.collect()) for r in d.collect()}
    assert got == want


def test_route_longest_prefix(spark):
    toks = spark.createDataFrame([("c", "packages", "com.a.b.c"), ("c", "libraries", "libx.so"), ("c", "methods", "com.a")], "case_id string, family string, token string")
    routes = spark.createDataFrame([("com.a", "short"), ("com.a.b", "long"), ("com.a.bb", "no")], "prefix string, repo string")
    so = spark.createDataFrame([("libx.so", "native")], "soname string, repo string")
    assert {r.repo for r in ranking.route_tokens(toks, routes, so).collect()} == {"long", "native"}


@pytest.mark.parametrize("block", [3, 100])
def test_vector_search_equals_brute_force_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "UNIT_BLOCK", block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    u = rng.normal(size=(20, 4)).tolist()
    q = rng.normal(size=(7, 4)).tolist()
    u[5] = [0.0] * 4
    u[6] = [1.0, 2.0]
    us = spark.createDataFrame([(i, f"r{i % 3}", "symbol", f"f{i}", v) for i, v in enumerate(u)], "uid long, repo string, kind string, file string, vec array<double>")
    qs = spark.createDataFrame([(i, v) for i, v in enumerate(q)], "qid long, vec array<double>")
    got = {(r.qid, r.rank): (r.uid, r.score) for r in vectors.vector_search(us, qs, 20).collect()}

    def cos(a, b):
        if len(a) != len(b) or not any(a) or not any(b):
            return -1.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for i, v in enumerate(q):
        want = sorted(((-cos(v, w), j) for j, w in enumerate(u)))
        assert [got[(i, k + 1)][0] for k in range(20)] == [j for _, j in want]
        assert all(abs(got[(i, k + 1)][1] + s) < 1e-8 for k, (s, _) in enumerate(want))


def test_dim_mismatch_fails(spark):
    a = spark.createDataFrame([([1.0, 2.0],)], "vec array<double>")
    b = spark.createDataFrame([([1.0],)], "vec array<double>")
    assert vectors.check_dim(a, b).first().ok is False
    with pytest.raises(Exception, match="query dim 1 != indexed dim 2"):
        vectors.require_dim(a, b).collect()


def test_rrf_keeps_first_seen_on_ties(spark):
    def ranked(*ids):
        return spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(ids)], "qid string, id string, rank int")
    out = fusion.rrf([ranked("a", "b"), ranked("b", "a"), ranked("c")], ["qid"], "id").orderBy("rank").collect()
    assert [r.id for r in out] == ["a", "b", "c"]


def test_quota_backfills_short_side(spark):
    def side(n, p):
        return spark.createDataFrame([("q", f"{p}{i}", i + 1) for i in range(n)], "qid string, uid string, rank int")
    got = fusion.merge_quota(side(10, "s"), side(1, "d"), 6).orderBy("pos").collect()
    assert [r.uid for r in got] == ["s0", "d0", "s1", "s2", "s3", "s4"]


def test_ground_order_and_parse(spark):
    pool = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abc")], "qid string, id string, rank int")
    said = spark.createDataFrame([("q", "C, zzz\nA")], "qid string, reply string")
    order = fusion.parse_order(pool.select("qid", "id"), said, ["qid"], "id")
    assert [r.id for r in fusion.ground_order(pool, order, ["qid"], "id").orderBy("rank").collect()] == ["c", "a", "b"]


def fault_of(spark, *lines):
    text = "\n".join(lines)
    att = spark.createDataFrame([("c", 0, text)], "case_id string, ord int, content string")
    return faults.fault_records(faults.parse_lines(faults.log_lines(att))).collect()


HEAD = "07-05 10:34:07.221  4821  4821 E AndroidRuntime: "


def test_fault_record_skips_framework(spark):
    r = fault_of(spark, "noise", HEAD + "FATAL EXCEPTION: main", HEAD + "java.lang.NullPointerException: x",
                 HEAD + "  at android.os.Handler.run(Handler.java:1)", HEAD + "  at org.demo.io.Writer.write(Writer.java:42)")[0]
    assert (r.family, r.top_frame_key, r.fault_file_hint, r.confidence) == ("java", "org.demo.io.Writer.write", "Writer.java", "HIGH")
    assert r.exception == "java.lang.NullPointerException"


def test_fault_record_native_low_and_none(spark):
    r = fault_of(spark, "07-05 10:34:07.221 1 1 F libc: Fatal signal 11", "#00 pc 00ab  /x/libcge.so (Cls::go+12)")[0]
    assert (r.family, r.top_frame_key, r.confidence) == ("native", "Cls::go", "HIGH")
    r = fault_of(spark, HEAD + "FATAL EXCEPTION: main", HEAD + " at android.os.Handler.run(Handler.java:1)")[0]
    assert r.confidence == "LOW"
    assert fault_of(spark, "07-05 10:34:07.221 1 1 I Foo: nothing crashed here") == []


def test_block_is_cut_at_its_size(spark):
    lines = [HEAD + "FATAL EXCEPTION: main"] + [f"line {i}" for i in range(30)]
    att = spark.createDataFrame([("c", 0, "\n".join(lines))], "case_id string, ord int, content string")
    parsed = faults.parse_lines(faults.log_lines(att))
    b = faults.blocks(parsed, faults.anchors(parsed), 10).first()
    assert b.n_lines == 10 and b.block.endswith("line 8")


OWNER = dict(owner_namespaces=["org.demo"], owner_slugs=["demo-app"], owner_sonames=["libDemo.so", "libc.so"],
             expected_files=["lib/src/main/jni/imageHandler.cpp"], fix_patch="@@\n-int old;\n+long nativeCreateHandler() { return newImpl(); }\n", github_slug="x/y")


def scrub_one(spark, prose, log):
    schema = ("owner_namespaces array<string>, owner_slugs array<string>, owner_sonames array<string>, expected_files array<string>, fix_patch string, "
              "github_slug string, prose string, logs array<struct<kind:string,text:string>>, owner string")
    df = spark.createDataFrame([(*OWNER.values(), prose, [("other", log)], "demo-app")], schema)
    return mining.with_verdict(mining.scrubbed(mining.with_owner_tokens(df), ["prose"], "logs"), "prose", "logs", "owner").first()


def test_scrub_masks_owner_and_keeps_generic(spark):
    r = scrub_one(spark, "seen in Demo-App", "java.lang.UnsatisfiedLinkError\n at org.demo.nat.Handler.nativeCreateHandler(Handler.java:87)\n"
                                             " at android.opengl.View.run(View.java:15) libffmpeg.so libDemo.so")
    text = r.logs[0].text
    assert "org.demo" not in text and "nativeCreateHandler" not in text and ".java:87" not in text and "libDemo" not in text
    assert "UnsatisfiedLinkError" in text and "android.opengl.View" in text and "libffmpeg.so" in text
    assert r.prose == "seen in <REDACTED_REPO>" and r.verdict == "ADMIT"


def every_rule(c, rules):
    return F.aggregate(rules, F.coalesce(c, F.lit("")), lambda acc, r: F.regexp_replace(acc, r["pattern"], r["mask"]))


def test_scrub_equals_applying_every_rule(spark):
    rnd = random.Random(5)
    parts = ["com", "acme", "Foo", "foo", "REDACTED_PATH", "SRC", "é", "x1", "_y", "\u212a"]
    glue = [".", "/", " ", "", "<", ">", "(", "\n", "-", ":"]

    def words(n):
        return "".join(rnd.choice(parts) + rnd.choice(glue) for _ in range(n))

    def token(text):
        at = rnd.randrange(len(text))
        return rnd.choice([words(rnd.randint(1, 4)), text[at:at + rnd.randint(1, 20)]]) + rnd.choice(["", "", ".so", "bar"])

    families = ["PKG", "SO", "PATH", "METHOD", "REPO", "PATCH"]
    texts = [words(30) for _ in range(300)]
    rows = [(i, t if i else None, [(rnd.choice(families), token(t)) for _ in range(12)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string, tokens array<struct<family:string,token:string>>").withColumn("rules", X.redactions(F.col("tokens")))
    got = df.select("t", X.scrub(F.col("t"), F.col("rules")).alias("a"), every_rule(F.col("t"), F.col("rules")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[0].a == "" and sum(r.a != r.t for r in got) > 200


def test_rules_of_absent_tokens_are_left_out(spark, one):
    tokens = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.struct(
        F.element_at(F.array(*[F.lit(f) for f in ("PKG", "SO", "PATH", "METHOD", "REPO", "PATCH")]), (i % 6 + 1).cast("int")).alias("family"),
        F.concat(F.lit("org.Absent"), i, F.lit(".end")).alias("token")))
    left = one(X.possible(X.redactions(tokens), F.lit("at org.Absent6.end.run(File.java:3) and Absent11 end")))
    assert {r.anchor for r in left} == {None, "absent6", "absent11"}


def test_unknown_library_rejects_and_prose_buckets(spark):
    assert scrub_one(spark, "x", "libstrange.so died").verdict == "REJECT"
    assert scrub_one(spark, "only words", "more words").verdict == "BUCKET_PROSE_ONLY"


def test_ordinal_matches_row_number(spark):
    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    got = session.with_ordinal(df, [F.col("k"), F.col("id")]).collect()
    want = {x: i + 1 for i, x in enumerate(sorted((r.k, r.id) for r in got))}
    assert all(want[(r.k, r.id)] == r.ordinal for r in got)


def tarjan_groups(n, edges):
    reach = [[i == j for j in range(n)] for i in range(n)]
    for a, b in edges:
        reach[a][b] = True
    for k in range(n):
        for i in range(n):
            if reach[i][k]:
                reach[i] = [x or y for x, y in zip(reach[i], reach[k])]
    label = {i: min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)}
    return {i: lb for i, lb in label.items() if sum(v == lb for v in label.values()) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_order_and_breaking(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(rnd.randrange(25), rnd.randrange(25)) for _ in range(38)})
    e = spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.label for r in graph.cycle_groups(e).collect()} == tarjan_groups(25, edges)
    kept = {(r.src, r.dst) for r in graph.break_cycles(e).collect()}
    assert not tarjan_groups(25, kept) and kept <= set(edges)
    level = {r.id: r.level for r in graph.dependency_order(spark.range(25), e).collect()}
    assert len(level) == 25 and all(level[a] > level[b] for a, b in kept)


def test_leaf_rule(spark):
    comp = spark.createDataFrame([("A", "class"), ("B", "class"), ("ErrorX", "class"), ("f", "function")], "id string, component_type string")
    e = spark.createDataFrame([("A", "B")], "src string, dst string")
    assert {r.id for r in graph.leaf_nodes(comp, e, False).collect()} == {"A", "B"}
    assert {r.id for r in graph.leaf_nodes(comp, e, True).collect()} == {"A"}


def ctx_rows(spark):
    rows = [("c1", "repoA", "boom in native method libx.so", ["com.Demo"], ["LinkError"]), ("c2", "repoB", "quiet words", [], []), ("c3", None, "", [], ["x"])]
    df = spark.createDataFrame(rows, "ctx_id string, repo string, text string, classes array<string>, errors array<string>")
    none = F.array().cast("array<string>")
    return df.withColumns({f: none for f in ("packages", "methods", "symbols", "libraries")})


RULES = [("any", "any_text", "BOOM"), ("all", "all_text", "native"), ("all", "all_text", "method"), ("half", "all_text", "native"), ("half", "all_text", "zzz"),
         ("re", "any_text_regex", r"lib\w+\.so"), ("cls", "any_classes", "demo"), ("err", "any_errors_regex", "^link"), ("repo", "repo_in", "RepoB"), ("on", "always", "true")]


def test_rules_fire(spark):
    r = spark.createDataFrame(RULES, "rule_id string, key string, value string")
    got = {(x.ctx_id, x.rule_id) for x in rules.fired(ctx_rows(spark), r).collect()}
    assert got == {("c1", x) for x in ("any", "all", "re", "cls", "err", "on")} | {("c2", "repo"), ("c2", "on"), ("c3", "on")}


def test_literals_and_patterns_hold_where_they_hold(spark):
    rng = random.Random(4)
    piece = ["boom", "lib", "x.so", " ", "::", "é", "naïve", "a", "_b1", "native", "\n", "Zz", "na"]
    texts = ["".join(rng.choice(piece) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["", None]
    values = sorted({"".join(rng.choice(piece) for _ in range(rng.randrange(1, 4))) for _ in range(80)} | {"", "::", "oo", "o", "ibx", "n", " "})
    patterns = [r"lib\w+\.so", r"^boom", r"n?a_b1", r"(boom|lib)x", r"a{2}", r"[bl]ib", r"na+tive", r"\bnative\b", r"x\.so$", r"(?:lib)?boom", r"nat.ve", r"éa*"]
    fields = spark.createDataFrame([(i, "text", t) for i, t in enumerate(texts)], "row int, field string, hay string").withColumn("toks", F.lit(None).cast("array<string>"))
    wanted = [("text", "literal", v) for v in values] + [("text", "pattern", p) for p in patterns] + [("text", "literal", None)]
    asked = spark.createDataFrame(wanted, "field string, kind string, value string")
    found = matching.matches(fields, asked).join(asked.withColumn("id", matching.identity("field", "kind", "value")), "id")
    got = {(r.row, r.kind, r.value) for r in found.collect()}
    want = {(i, "literal", v) for i, t in enumerate(texts) if t is not None for v in values if v in t}
    want |= {(i, "pattern", p) for i, t in enumerate(texts) if t is not None for p in patterns if re.search(p, t, re.I)}
    assert got == want


def test_rules_need_no_python_worker(spark):
    plan = rules.fired(ctx_rows(spark), spark.createDataFrame(RULES, "rule_id string, key string, value string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoop"))


def test_unknown_key_fails(spark):
    r = spark.createDataFrame([("x", "odd", "1")], "rule_id string, key string, value string")
    with pytest.raises(Exception, match="unknown predicate keys"):
        rules.fired(ctx_rows(spark), r).collect()


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_verdict_fold_is_chunk_free(spark, chunk):
    rnd = random.Random(5)
    rows = [(f"i{j % 4}", j, rnd.random() < 0.45) for j in range(120)]
    v = spark.createDataFrame(rows, "item string, seq long, passed boolean")
    got = {r.item: (r.tier, r.fail_count, r.demotions) for r in rules.fold_verdicts(v, chunk=chunk).collect()}
    tiers, want = rules.V.TIERS, {}
    for item, _, ok in rows:
        t, s, d = want.get(item, (0, 0, []))
        if ok:
            t, s = min(t + 1, 3), 0
        elif s + 1 >= 2:
            d = d + [f"{tiers[t]}->{tiers[max(t - 1, 0)]}"]
            t, s = max(t - 1, 0), 0
        else:
            s += 1
        want[item] = (t, s, d)
    assert got == {k: (tiers[t], s, d) for k, (t, s, d) in want.items()}


def test_scorecard_block(spark):
    recs = spark.createDataFrame([("c1", "m", ["g", "x"], [5.0, 1.0], "g", 4.0, 5.0), ("c2", "m", ["x", "g"], [2.0, 2.0], None, 0.0, 2.0)],
                                 "case_id string, arm string, ranked_names array<string>, scores array<double>, predicted string, margin double, top1_score double")
    lab = spark.createDataFrame([("c1", "g", True, None, None), ("c2", "g", True, None, None)],
                                "case_id string, owning_repo string, is_answerable boolean, negative_class string, bug_kind string")
    c = grading.scorecard(grading.per_case(recs, lab)).first()
    assert (c.n, c.recall_1, c.recall_3, c.coverage, c.selective_accuracy, c.phi_1_0) == (2, 0.5, 1.0, 0.5, 1.0, 0.5)


def test_null_is_neither_solved_nor_broken(spark):
    b = spark.createDataFrame([("a", False), ("b", True), ("c", None), ("d", True)], "case_id string, resolved boolean")
    h = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", None), ("e", True)], "case_id string, resolved boolean")
    assert {(r.case_id, r.change) for r in grading.resolved_diff(b, h).collect()} == {("a", "newly_solved"), ("b", "newly_broken")}


def test_plan_grounding_never_reads_out_of_scope(spark):
    plan = '{"root_cause": "r", "strategy": "s", "targets": [{"file": "a.c", "symbol": "go"}, {"file": "../x/_oracle/o.json"}, {"file": "gone.c"}], "required_apis": ["go"]}'
    df = spark.createDataFrame([("c", "r", plan, ["a.c", "gone.c"])], "case_id string, repo string, t string, candidates array<string>")
    files = spark.createDataFrame([("r", "a.c", "void go() {}"), ("r", "../x/_oracle/o.json", "go")], "repo string, file string, text string")
    r = context.check_plans(df.withColumn("plan", X.parse_plan(F.col("t"))), files).first()
    assert (r.ok, r.n_citations, r.n_resolved) == (False, 5, 3)
    assert r.failures == ["target_file_missing:gone.c", "target_out_of_scope:../x/_oracle/o.json"]


def test_deep_module_chain_and_lost_modules(spark):
    rows = [("m0", None, "root")] + [(f"m{i}", f"m{i - 1}", None) for i in range(1, 70)]
    tree = graph.module_tree(spark.createDataFrame(rows, "module string, parent string, path string"))
    assert tree.count() == 70 and tree.agg({"depth": "max"}).first()[0] == 69
    with pytest.raises(ValueError, match="below no root"):
        graph.module_tree(spark.createDataFrame([*rows[:2], ("x", "y", None), ("y", "x", None)], "module string, parent string, path string"))


def test_cycle_groups_never_stop_early(spark, monkeypatch):
    pairs = [(i, j) for i in range(10) for j in ((i + 1) % 10, (i + 2) % 10)]  # no chains to contract
    monkeypatch.setattr(graph, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        graph.cycle_groups(spark.createDataFrame(pairs, "src long, dst long"))


@pytest.fixture
def rounds(monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(1) or session.cut(df))
    return seen


def chain_and(spark, n, *pairs):
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame(pairs, "src long, dst long"))


def test_long_circle_takes_few_rounds(spark, rounds):
    got = graph.cycle_groups(chain_and(spark, 10_000, (9999, 0)))
    assert got.count() == 10_000 and got.select("label").distinct().collect() == [(0,)] and len(rounds) < 40


@pytest.mark.parametrize("seed", [3])
def test_contracted_groups_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = {(i, rnd.randrange(40)) for i in range(40)} | {(rnd.randrange(40), rnd.randrange(40)) for _ in range(seed * 3)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.id: r.label for r in graph.cycle_groups(e).collect()} == tarjan_groups(40, edges)


def test_places_go_to_the_catalog_alone(spark):
    units = [(i, "big", "symbol", f"u{i}", f"q.u{i}", f"f{i}", "token here") for i in range(25)] + [(99, "small", "symbol", "s", "q.s", "fs", "token here and other words to be longer")]
    df = spark.createDataFrame(units, "uid long, repo string, kind string, name string, qualified_name string, file string, text string")
    tokens = spark.createDataFrame([("c1", "token"), ("c2", "token")], "case_id string, token string")
    cands = spark.createDataFrame([("c1", "small", 0), ("c2", "big", 0), ("c2", "small", 1)], "case_id string, repo string, pos int")
    got = {(r.case_id, r.repo): r.score for r in ranking.membership(df, tokens, cands).collect()}
    assert got == {("c1", "small"): 1.0, ("c2", "big"): 1.0, ("c2", "small"): 0.0}


def test_promotion_keeps_old_evidence_where_none_is_given(spark):
    from faultlens.operators import rules
    kind = "id string, tier string, fail_count int, demotions array<string>, passed boolean, measured_lift double, wilson95 struct<low:double,high:double>"
    items = spark.createDataFrame([("a", "candidate", 0, [], True, 0.1, (0.0, 0.5)), ("b", "applied", 1, [], False, 0.2, None), ("c", "retired", 0, [], True, 0.3, None)], kind)
    given = spark.createDataFrame([("a", 0.9, None), ("c", 0.8, (0.1, 0.2))], "id string, measured_lift double, wilson95 struct<low:double,high:double>")
    got = {r.id: (r.tier, r.measured_lift, r.wilson95 and tuple(r.wilson95)) for r in rules.promote_or_retire(items, evidence=given).collect()}
    assert got == {"a": ("applied", 0.9, (0.0, 0.5)), "b": ("candidate", 0.2, None), "c": ("retired", 0.3, None)}


def test_evidence_counts_cases_an_item_fired_in(spark):
    from faultlens.operators import rules
    archive = spark.createDataFrame([(1, ["a", "a"], 0.5, True), (2, ["a"], 0.5, None), (3, ["b"], 0.5, True), (4, ["a"], None, True)],
                                    "case_id long, fired array<string>, groundedness double, patch_applies boolean")
    items = spark.createDataFrame([("a", "candidate"), ("b", "retired")], "id string, tier string")
    (r,) = rules.lift_evidence(archive, items).collect()
    assert r.id == "a" and abs(r.measured_lift - (0.5 - 0.75)) < 1e-9 and abs(r.wilson95.low + r.wilson95.high - 1) < 1e-9
    assert [tuple(x) for x in rules.validating_cases(archive, items).collect()] == [("a", 1)]


def test_minting_drops_ungrounded_fixes(spark):
    from faultlens.operators import rules
    families = "struct<packages:array<string>,classes:array<string>,methods:array<string>,symbols:array<string>,libraries:array<string>,errors:array<string>>"
    def fix(case, method, error, line):
        return case, ([], [], [method], [], [], [error]), [], f"+++ b/x\n+  {line}"
    fixes = spark.createDataFrame([fix(1, "drawFrame", "E1", "drawFrame();"), fix(2, "drawFrame", "E1", "other();"), fix(3, "lostCall", "E1", "lostCall();"),
                                   fix(4, "drawFrame", "acme", "drawFrame();"), fix(1, "drawFrame", "E1", "drawFrame();")],
                                  f"case_id long, signals {families}, locations array<string>, patch_diff string")
    units = spark.createDataFrame([("r/1", "r", "symbol", "drawFrame", "View.drawFrame", "void drawFrame()", "View.java")],
                                  "uid string, repo string, kind string, name string, qualified_name string, text string, file string")
    deny = spark.createDataFrame([("acme",)], "token string")
    assert [(r.signature, r.refs, r.provenance) for r in rules.mint_grounded(fixes, units, deny).collect()] == [("E1 drawFrame", ["drawFrame"], "minted:1")]
