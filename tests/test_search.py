import numpy as np
import pytest

from quernel.config import Search
from quernel.operators import fulltext, hybrid, vectors
from quernel.plans.query_language import parse

DOCS = [
    ("a.md", "Elm trees", "An elm is a tree of river banks; its bark is rough", "bark,tree"),
    ("b.md", "Oak woods", "The oak is a tree; acorns and bark feed the pigs", "tree"),
    ("c.md", "Soup", "Boil barley. A rough stock of bones", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return fulltext.documents(spark.createDataFrame(DOCS, "path string, title string, body string, tags string"))


CASES = {
    "elm": "a", "river": "a", "elm oak": "ab", "bark AND tree": "ab", "bark -elm": "b", "rough -elm": "c", "+rough +stock": "c", "tree NOT (elm OR soup)": "b",
    '"is a tree"': "ab", '"a tree"': "ab", '"tree a"': "", '"rough bones"~2': "c", '"river ban"*': "a", "title:oak": "b", "tags:tree": "ab", "tags:bark": "a", "path:c.md": "c", "elm^3 OR barley": "ac", "*": "abc",
    "title:[oak TO woods]": "abc", "title:{oak TO trees}": "c", "title:IN [elm soup]": "ac", "it's": "", "(((": "abc", "": "abc", "nowhere:elm": "", "-elm": "",
}


@pytest.mark.parametrize("query", CASES)
def test_matches_with_and_without_index(docs, query):
    scan = {r.path[0]: r.score for r in fulltext.search(docs, query, None).collect()}
    held = {r.path[0]: r.score for r in fulltext.search_index(fulltext.postings(docs), fulltext.lengths(docs), query, None).collect()}
    assert scan == pytest.approx(held)
    assert "".join(sorted(scan)) == CASES[query]


def test_ranking_limits_and_empty_index(docs):
    assert fulltext.search(docs, "elm", 10).first().path == "a.md"
    assert fulltext.search(docs, "tree", 1).count() == 1 and fulltext.search(docs, "tree", 0).count() == 0
    assert fulltext.search(docs.where("false"), "tree", 5).count() == 0
    once, twice = (fulltext.search(docs, q, 1).first().score for q in ("elm", "elm^2"))
    assert twice == pytest.approx(2 * once)
    few = fulltext.postings(docs, 3)
    assert {r.bucket for r in few.collect()} == {0, 1, 2}
    assert fulltext.search_index(few, fulltext.lengths(docs), "elm", 5, buckets=3).count() == 1
    assert fulltext.postings(docs.where("false")).count() == 0


def test_unreadable_query_becomes_a_phrase():
    assert parse('elm "open').may[0].words == ["elm", "open"]
    assert parse("?!").may[0].kind == "all"


VECTORS = "path string, title string, tags string, heading string, start_line int, end_line int, text string, embedding array<float>"


def held(spark, rows):
    return spark.createDataFrame([(p, p, t, "", 1, 2, p, v) for p, t, v in rows], VECTORS)


def test_nearest(spark):
    v = held(spark, [("a", "", [2.0, 0.0, 0.0]), ("b", "", [0.0, 3.0, 0.0]), ("c", "", [0.6, 0.8, 0.0]), ("z", "", [0.0, 0.0, 0.0]), ("n", "", [-1.0, 0.0, 0.0])])
    assert [r.path for r in vectors.knn(v, [1, 0, 0], 2).collect()] == ["a", "c"]
    scores = {r.path: r.score for r in vectors.scored(v, [1, 0, 0]).collect()}
    assert scores["a"] == 1 and scores["b"] == 0 and scores["n"] == -1 and scores["z"] == 0
    assert vectors.knn(v, [0, 0, 0], 3).count() == 0 and vectors.knn(v.where("false"), [1, 0, 0], 3).count() == 0
    assert vectors.dimension(v) == 3 and vectors.dimension(v.where("false")) is None
    assert vectors.remove_paths(v, v.where("path = 'a'")).count() == 4


def test_filters_come_after_the_nearest(spark):
    v = held(spark, [("wiki/a", "x,y", [1.0, 0.0]), ("wiki2/b", "x", [0.9, 0.1]), ("c", "", [0.8, 0.2])])
    assert [r.path for r in vectors.semantic(v, [1, 0], 2, folders=["wiki"]).collect()] == ["wiki/a", "wiki2/b"]
    assert vectors.semantic(v, [1, 0], 2, folders=["c"]).count() == 0
    assert vectors.semantic(v, [1, 0], 2, folders=["c"], prefilter=True).count() == 1
    assert [r.path for r in vectors.semantic(v, [1, 0], 3, tags=["x", "y"]).collect()] == ["wiki/a"]


def test_fusion(spark):
    hits = spark.createDataFrame([("a", "A", 4.0), ("d", "D", 1.0)], "path string, title string, score double")
    near = vectors.semantic(held(spark, [("a", "", [0.6, 0.8]), ("b", "", [0.8, 0.6])]), [1, 0], 4)
    got = {r.path: r for r in hybrid.merge(near, hybrid.fts_results(hits), 10).collect()}
    assert got["a"].match_type == "hybrid" and got["a"].score == pytest.approx(0.7 * 0.6 + 0.3, abs=1e-6)
    assert got["b"].match_type == "semantic" and got["b"].score == pytest.approx(0.8, abs=1e-6)
    assert got["d"].match_type == "fts" and got["d"].score == pytest.approx(0.3 / 4) and got["d"].chunk == "[FTS match]"
    assert hybrid.merge(near, hybrid.fts_results(hits), 2, Search()).count() == 2
    assert hybrid.merge(near.where("false"), hybrid.fts_results(hits.where("false")), 2).count() == 0
    merged = hybrid.merge(near, hybrid.fts_results(hits), 10)
    assert hybrid.exclude(merged, ["a", "d"]).count() == 1 and hybrid.threshold(merged, 0.72).count() == 2


def test_knn_batch_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", 7)
    monkeypatch.setattr(vectors, "AT_ONCE", 3, raising=False)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((60, 5))
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    queries = held.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {(q, int(v), r + 1) for q in range(0, 60, 2) for r, v in enumerate(np.lexsort((np.arange(60), -score[q]))[:4])}
    rows = vectors.knn_batch(held, queries, 4, digits=6).collect()
    assert len(rows) == len(want) and {(r.query_id, r.vec_id, r["rank"]) for r in rows} == want
    assert vectors.knn_batch(held, queries.where("false"), 4).count() == 0 and vectors.knn_batch(held.where("false"), queries, 4).count() == 0
