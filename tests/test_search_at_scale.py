"""Searches of many queries meet as few postings as they can, and lose none of the best."""
import pytest

from faultlens.operators import lexical


@pytest.fixture
def fleet(spark):
    rows = [(i, f"r{i % 5}", "symbol" if i % 3 else "doc", f"Doc{i}", f"r{i % 5}.en.Doc{i}", f"f{i % 40}.java", "en " * (i % 7) + f"word{i % 9} Doc{(i * 7) % 200}") for i in range(200)]
    return spark.createDataFrame(rows, "uid long, repo string, kind string, name string, qualified_name string, file string, text string").cache()


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(i, f"r{i % 5}.en.Doc{i} word{i % 9}", f"r{(i + 1) % 5}") for i in range(150)], "qid long, query string, repo_name string").cache()


@pytest.fixture
def scored(monkeypatch):
    """Numbers of the (query, unit) rows that a search has scored."""
    seen, bm25 = [], lexical.bm25

    def counted(*args):
        out = bm25(*args)
        seen.append(out.count())
        return out
    monkeypatch.setattr(lexical, "bm25", counted)
    return seen


def by_hand(units, queries, k, scoped):
    """The k best of each query, every query scored on its own against all units."""
    index = lexical.written(lexical.build_index(units, lexical.query_vocabulary(queries)))
    terms = lexical.query_vocabulary(queries).join(lexical.term_weights(index), "term").drop("df")
    rows = lexical.bm25(index.postings, terms).drop("repo").join(units.select("uid", "repo", "kind"), "uid").join(queries.select("qid", "repo_name"), "qid")
    rows = rows.where("repo = repo_name AND kind = 'symbol'") if scoped else rows
    return sorted((r.qid, r["rank"], r.uid, r.score) for r in lexical.top_k(rows, k, ["qid"], ["score", "uid"]).collect())


@pytest.mark.parametrize("scoped", [False, True])
def test_shared_terms_are_searched_once(fleet, asked, scored, scoped):
    how = dict(kinds=["symbol"], scope="repo_name") if scoped else {}
    got = sorted((r.qid, r["rank"], r.uid, r.score) for r in lexical.search(fleet, asked, 7, **how).collect())
    assert sum(scored) < 45 * 200 + 1  # 45 pairs of repo and word beside a name of its own; 150 * 200 without sharing
    assert got == by_hand(fleet, asked, 7, scoped) and len(got) == 150 * 7


def test_scope_is_met_before_scoring(spark, fleet, scored):
    one = spark.createDataFrame([(i, "en", f"r{i}") for i in range(5)], "qid long, query string, repo_name string")
    assert lexical.search(fleet, one, 3, scope="repo_name").count() == 15
    assert sum(scored) == 200  # each unit for its own repo's query, not for all five


def test_catalogs_meet_only_the_best_of_each_repo(spark, fleet, scored):
    tokens = spark.createDataFrame([(t, c) for t in ("en", "word3") for c in range(4)], "token string, cat int")
    catalogs = spark.createDataFrame([(c, f"r{r}") for c in range(4) for r in range(5) if r != c], "cat int, repo string")
    got = sorted((r.token, r.cat, r["rank"], r.uid) for r in lexical.token_hits(fleet, tokens, 4, catalogs).collect())
    assert sum(scored) <= 400
    every = lexical.token_hits(fleet, tokens.select("token").distinct(), 200).collect()
    want = []
    for t in ("en", "word3"):
        for c in range(4):
            kept = sorted((r.score, r.uid) for r in every if r.token == t and r.repo != f"r{c}")[:4]
            want += [(t, c, i + 1, uid) for i, (_, uid) in enumerate(kept)]
    assert got == sorted(want)


def test_tasks_grow_in_number_with_the_pairs(fleet, asked, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 50)
    index = lexical.written(lexical.build_index(fleet, lexical.query_vocabulary(asked)))
    terms = lexical.query_vocabulary(asked).join(lexical.term_weights(index), "term").drop("df")
    met = terms.join(index.postings, "term").count()
    assert lexical.bm25(index.postings, terms).rdd.getNumPartitions() >= met / 50


def test_terms_are_counted_within_the_row(fleet):
    index = lexical.build_index(fleet)
    rows = {r.uid: r for r in index.postings.where("term = 'en'").collect()}
    assert all(rows[i].tf == 1 + i % 7 for i in range(200))
    assert {r.tf for r in index.postings.where("term = ''").collect()} == {1}
    assert "Exchange hashpartitioning" not in index.postings._jdf.queryExecution().executedPlan().toString()
