import json

import pytest
from pyspark.sql import functions as F

from faultlens.operators import ranking
from faultlens.operators import blockmax, lexical
from faultlens.sources import cases, files, index_store, records, snapshots


@pytest.fixture
def dataset(tmp_path):
    def case(name, ticket, oracle=None, catalog=None, logs=()):
        d = tmp_path / name
        (d / "logs").mkdir(parents=True)
        (d / "ticket.json").write_text(json.dumps(ticket))
        for file, body in logs:
            (d / file).write_bytes(body)
        if oracle:
            (d / "_oracle").mkdir()
            (d / "_oracle" / "oracle.json").write_text(json.dumps(oracle))
        if catalog:
            (d / "catalog.json").write_text(json.dumps([{"name": n} for n in catalog]))
    (tmp_path / "catalog.json").write_text(json.dumps([{"name": n} for n in ("z", "a")]))
    case("one", {"id": "one", "summary": "s", "logs": [{"path": "logs/b.txt", "kind": "logcat"}, {"path": "logs/a.txt"}]},
         {"owning_repo": "a", "expected_files": ["x.c"]}, logs=[("logs/a.txt", b"first \xff bad"), ("logs/b.txt", b"second")])
    case("two", {"id": "two", "logs": [{"path": "p", "content": "inline"}]},
         {"owning_repo": "b", "is_answerable": False, "negative_class": "out_of_fleet"}, catalog=["q"])
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def test_cases_and_attachments(spark, dataset):
    rows = {r.case_id: r for r in cases.load_tickets(spark, dataset).collect()}
    assert set(rows) == {"one", "two"}
    assert [(g.kind, g.content) for g in rows["one"].logs] == [("logcat", "second"), ("other", "first � bad")]
    assert rows["two"].log_text == "inline" and rows["two"].status == "Open" and rows["two"].component == ""


def test_labels_need_the_explicit_glob_and_stay_out_of_predictions(spark, dataset):
    labels = {r.case_id: r for r in cases.load_labels(spark, dataset).collect()}
    assert labels["one"].is_answerable is True and labels["one"].expected_files == ["x.c"] and labels["one"].required_apis == []
    assert labels["two"].is_answerable is False
    seen = cases.load_tickets(spark, dataset)
    assert not any("_oracle" in f for f in seen.inputFiles())


def test_case_catalog_overrides_the_fleet(spark, dataset):
    got = ranking.candidates(cases.load_cases(spark, dataset), cases.global_catalog(spark, dataset), cases.case_catalogs(spark, dataset))
    assert {(r.case_id, r.repo, r.pos) for r in got.collect()} == {("one", "z", 0), ("one", "a", 1), ("two", "q", 0)}


def test_colliding_ids_and_bad_classes_fail(spark):
    df = spark.createDataFrame([("x",)], "case_id string")
    with pytest.raises(Exception, match="case id collision: x"):
        cases.combine_cases({"a": df, "b": df}).collect()
    schema = "case_id string, negative_class string, held_out_repo string, case_catalog array<string>"
    with pytest.raises(Exception, match="unknown negative_class"):
        cases.checked_cases(spark.createDataFrame([("x", "odd", None, None)], schema)).collect()
    with pytest.raises(Exception, match="held_out_repo"):
        cases.checked_cases(spark.createDataFrame([("x", None, "r", ["r"])], schema)).collect()


def test_wiki_lists_only_manifest_files(spark, tmp_path):
    for repo, names in (("m", ["a.md", "b.md"]), ("n", ["c.md"])):
        (tmp_path / repo).mkdir()
        for n in names:
            (tmp_path / repo / n).write_text(f"# {n}\nbody")
    (tmp_path / "m" / "metadata.json").write_text(json.dumps({"files_generated": ["a.md", "tree.json"]}))
    docs = records.load_wiki(spark, str(tmp_path))
    assert {(r.repo, r.file) for r in docs.collect()} == {("m", "a.md"), ("n", "c.md")}
    u = index_store.doc_units(docs.withColumn("repo_head", F.lit("h"))).where("repo = 'm'").first()
    assert (u.name, u.text, u.meta) == ("a.md", "a.md\nbody", {"module": "a", "ord": "0"})


def test_source_tree_rules(spark, tmp_path):
    for p in ("src/A.java", "tests/T.java", "node_modules/x/y.js", "docs/a.min.js", "bin/run.py", "a.png", "lib/b.kt"):
        f = tmp_path / "repo" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * 1024)
    tree = files.source_tree(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"src/A.java", "lib/b.kt"}
    s = files.tree_summary(tree).first()
    assert (s.repo, s.total_files, s.total_size_kb) == ("repo", 2, 2.0)
    assert {r.path for r in files.source_tree(spark, str(tmp_path), ["*.kt"], []).collect()} == {"lib/b.kt"}


def test_lite_units_cap_files_and_keep_first(spark):
    rows = [("r", "b/B.java", "package p.q;\nclass Box {}"), ("r", "a/A.java", "package p.q;\nclass Box {}\nload(\"libz.so\")"), ("r", "z/Z.java", "class Zed {}"), ("r", "n.md", "class No {}")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    got = {r.qualified_name: (r.kind, r.file) for r in files.lite_units(df, 2).collect()}
    assert got == {"p.q": ("package", "a/A.java"), "p.q.Box": ("class", "a/A.java"), "Box": ("class", "a/A.java"), "libz.so": ("library", "a/A.java")}


def test_replacing_a_repo_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "units")
    df = spark.createDataFrame([("1", "a", "h1", "t"), ("1", "a", "h1", "t"), ("2", "b", "h1", "t")], "uid string, repo string, repo_head string, text string")
    index_store.write_units(df, path)
    index_store.write_units(df.where("repo = 'b'").withColumns({"uid": F.lit("9"), "repo_head": F.lit("h2")}), path)
    back = index_store.read_units(spark, path)
    assert {(r.repo, r.unit_count, r.repo_head) for r in index_store.repo_states(back).collect()} == {("a", 1, "h1"), ("b", 1, "h2")}


def test_toml_rules_and_registry(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[[skill]]\nid = "k"\nguidance = "Signature: x\\nFix: y"\n[skill.match]\nany_text = ["Boom"]\nalways = false\n')
    r = records.load_rules_toml(spark, str(tmp_path / "r.toml"))
    assert {tuple(x) for x in records.match_rows(r).collect()} == {("k", "any_text", "Boom"), ("k", "always", "false")}
    (tmp_path / "c.toml").write_text('[[repo]]\nname = "a"\nurl = "u"\nsha = "PIN_AT_CLONE"\n[[repo]]\nname = "b"\n')
    assert [tuple(x) for x in records.pinned_corpus(records.load_registry(spark, str(tmp_path / "c.toml"))).collect()] == [("a", "u", "")]


def test_duplicate_markdown_rule_fails(spark):
    md = "---\nid: x\ntriggers: t\n---\nbody"
    texts = spark.createDataFrame([("a.md", md), ("b.md", md)], "path string, text string")
    table = spark.createDataFrame([("t", "any_text", "v")], "trigger string, key string, value string")
    with pytest.raises(Exception, match="duplicate skill id x"):
        records.rules_from_markdown(texts, table).collect()
    with pytest.raises(Exception, match="unknown trigger t"):
        records.rules_from_markdown(texts.limit(1), table.where("false")).collect()


def test_run_records_refuse_labels(spark, tmp_path):
    df = spark.createDataFrame([("a", "r")], "ticket_id string, owning_repo string")
    with pytest.raises(ValueError, match="label columns"):
        records.write_runs(df, str(tmp_path / "x"))


def test_archive_skips_malformed(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"case_id": "c", "arm": "x", "fired_knowledge": ["k"], "outcome": {"groundedness": 0.5}}\n{broken\n')
    rows = records.load_archive(spark, str(tmp_path / "p")).collect()
    assert [(r.case_id, r.fired, r.groundedness) for r in rows] == [("c", ["k"], 0.5)]


def test_broken_tickets_and_missing_attachments(spark, dataset, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "ticket.json").write_text("{bad json")
    assert {r.case_id for r in cases.load_cases(spark, dataset).collect()} == {"one", "two"}
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "ticket.json").write_text(json.dumps({"id": "lost", "logs": [{"path": "logs/none.txt"}]}))
    with pytest.raises(Exception, match="missing attachment lost logs/none.txt"):
        cases.load_tickets(spark, dataset).collect()
    rows = {r.case_id: r for r in cases.load_tickets(spark, dataset, missing="null").collect()}
    assert rows["lost"].logs[0].content is None and rows["one"].log_text.startswith("second")


# --- stored index: snapshots and posting blocks ---------------------------------------------------------

UNIT_ROWS = "uid string, repo string, kind string, name string, qualified_name string, file string, repo_head string, text string"


def some_units(spark, repos, n, words, extra=""):
    rows = [(f"{r}/{i}", r, "symbol" if i % 3 else "doc", f"N{i}", None, f"f{i}.java", "h", f"common {words[(i * i + len(r)) % len(words)]} {'common ' * (i % 5)}{extra}") for r in repos for i in range(n)]
    return spark.createDataFrame(rows, UNIT_ROWS)


def test_blocks_give_what_the_plain_search_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    units = some_units(spark, ["a", "bb", "c"], 150, ["alpha", "beta", "gamma rare", "delta alpha", "eps"])
    path = str(tmp_path / "index")
    index_store.write_index(units, path)
    queries = spark.createDataFrame([(1, "common alpha", "a"), (2, "rare common beta", "bb"), (3, "nothing here", "a"), (4, "common", "c"), (5, "gamma delta eps alpha", "zz"), (6, "", "a")], "qid int, query string, r string")
    stored = index_store.read_index(spark, path, queries)
    for k, more in ((7, {}), (1, {"kinds": ["symbol"]}), (1000, {"repos": ["a", "c"]}), (5, {"scope": "r", "kinds": ["doc"]})):
        want = lexical.search(units, queries, k, **more).select("qid", "uid", "repo", "kind", "file", "score", "rank")
        got = blockmax.keyword_search(stored, queries, k, **more)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_postings_are_shuffled_once_and_terms_not_copied(spark):
    posted = spark.sql("SELECT concat('r', id % 1) AS repo, concat('k', id % 1) AS kind, concat('t', id % 3) AS term, concat('u', id) AS uid, 5 AS len, 1 AS tf FROM range(600)")
    out = blockmax.blocks(posted, index_store.term_bucket(F.col("term")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_salt" not in plan
    rows = out.collect()
    assert sum(r.n for r in rows) == 600 and {(r.term, r.bits) for r in rows} == {("t0", 1), ("t1", 1), ("t2", 1)} and all(len(r.uids) == r.n for r in rows)


def test_fewer_blocks_are_opened_for_fewer_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 16)
    units = some_units(spark, ["a"], 2000, ["w"] * 40 + ["needle"])
    path = str(tmp_path / "index")
    index_store.write_index(units, path)
    queries = spark.createDataFrame([(1, "needle common")], "qid int, query string")
    stored = index_store.read_index(spark, path, queries)
    whole = stored.blocks.agg({"n": "sum"}).first()[0]
    read = [blockmax.plan(stored, queries, k).postings_read() for k in (1, 10, 2000)]
    assert read[0] <= read[1] < whole / 2 < whole <= read[2]


def test_replaced_repos_keep_no_vectors_and_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "index")
    units = some_units(spark, ["a", "b"], 6, ["x", "y"])
    with_vec = units.withColumn("vec", F.array(F.lit(1.0), F.lit(2.0)))
    index_store.write_index(with_vec, path)
    before = snapshots.latest(spark, path)[1]
    index_store.write_index(units.where("repo = 'a' AND uid < 'a/3'").withColumn("uid", F.concat("uid", F.lit("new"))), path)
    asked = spark.createDataFrame([(1, "x y common")], "qid int, query string")
    now = index_store.read_index(spark, path, asked)
    assert {r.repo for r in index_store.read_vectors(spark, path).collect()} == {"b"}
    assert {r.uid for r in now.units.where("repo = 'a'").collect()} == {"a/0new", "a/1new", "a/2new"} and now.units.count() == 9 and now.corpus.first().n == 9
    assert {r.uid for r in blockmax.keyword_search(now, asked, 100).collect()} == {r.uid for r in now.units.collect()}
    old = index_store.read_index(spark, path, asked, before)
    assert old.units.count() == 12 and old.corpus.first().n == 12 and index_store.read_vectors(spark, path, before).count() == 12


def test_a_write_that_fails_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    units = some_units(spark, ["a"], 5, ["x"])
    index_store.write_index(units, path)
    seen = snapshots.latest(spark, path)

    def killed(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", killed)
        with pytest.raises(RuntimeError, match="killed"):
            index_store.write_index(some_units(spark, ["a"], 2, ["y"]), path)
    bad = units.withColumn("text", F.when(F.col("uid") == "a/3", F.raise_error(F.lit("broken text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken text"):
        index_store.write_index(bad, path)
    (tmp_path / "index" / "commits" / "000000000002").write_text("half")  # a commit cut short
    assert snapshots.latest(spark, path) == seen
    asked = spark.createDataFrame([(1, "x")], "qid int, query string")
    assert index_store.read_index(spark, path, asked).units.count() == 5
    index_store.write_index(some_units(spark, ["b"], 2, ["y"]), path)
    assert snapshots.latest(spark, path)[0] == 3 and {r.repo for r in snapshots.read(spark, path).collect()} == {"a", "b"}


def test_first_units_tell_maps_apart(spark):
    df = spark.sql("SELECT 'u' AS uid, 'r' AS repo, map('k', v) AS meta FROM VALUES ('b'), ('a'), ('c') AS t(v)")
    assert {index_store.first_units(df.repartition(n)).first().meta["k"] for n in (1, 3)} == {"a"}
