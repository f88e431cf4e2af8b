from pyspark.sql import functions as F

from quernel.operators import graph
from quernel.operators.links import extract_links, wikilinks

NOTES = "path string, content string"


def targets(spark, text):
    return [(r.target, r.alias) for r in wikilinks(spark.createDataFrame([("n.md", text)], NOTES)).collect()]


def test_wikilinks(spark):
    assert targets(spark, "see [[a]] and [[b|B]] and [[c#h|C]]") == [("a", None), ("b", "B"), ("c", "C")]
    assert targets(spark, "```\n[[a]]\n~~~\n[[b]]\n```\n[[c]]\n```\n[[d]]") == [("b", None), ("d", None)]
    assert targets(spark, "`[[a]]` [[b]] `open [[c]]") == [("b", None)]
    assert targets(spark, "[[#heading]] [[]] [[open ![[e]]") == [("open ![[e", None)]
    assert targets(spark, "") == []


def test_resolution(spark):
    texts = [("wiki/a.md", "[[b]] [[deep/x]] [[c.md]] [[none]] [[sub\\d]]"), ("b.md", ""), ("wiki/deep/x.md", ""), ("z/c.md", ""), ("y/c.md", ""), ("wiki/sub/d.md", "[[b]]")]
    got = {(r.source_path, r.target_path) for r in extract_links(spark.createDataFrame(texts, NOTES)).collect()}
    assert got == {("wiki/a.md", t) for t in ("b.md", "wiki/deep/x.md", "y/c.md", "wiki/sub/d.md")} | {("wiki/sub/d.md", "b.md")}


def links(spark, *pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "source_path string, target_path string, context string")


def test_graph(spark):
    g = links(spark, ("a.md", "b.md"), ("a.md", "c.md"), ("b.md", "c.md"))
    assert graph.outgoing(g, "a.md").count() == 2 and graph.backlinks(g, "c.md").count() == 2
    assert {r.path: r.depth for r in graph.expand_nodes(g, "a.md", 1).collect()} == {"a.md": 0, "b.md": 1, "c.md": 1}
    assert graph.expand_edges(g, "a.md", 1).count() == 2 and graph.expand_edges(g, "a.md", 2).count() == 3
    assert {r.path for r in graph.propagate(g, "c.md", 2).collect()} == {"a.md", "b.md"}
    assert tuple(graph.stats(g).first()) == (3, 3)
    cycle = links(spark, ("a.md", "b.md"), ("b.md", "a.md"))
    assert graph.propagate(cycle, "a.md", 5).collect()[0].path == "b.md"


def test_updates_and_linked_notes(spark):
    g = links(spark, ("a.md", "b.md"), ("b.md", "c.md"))
    a = spark.createDataFrame([("a.md",)], "path string")
    fresh = links(spark, ("a.md", "d.md"), ("a.md", "d.md"))
    assert {(r.source_path, r.target_path) for r in graph.update_links(g, a, fresh).collect()} == {("a.md", "d.md"), ("b.md", "c.md")}
    assert graph.remove_sources(g, a).count() == 1
    results = spark.createDataFrame([("a.md", 1), ("c.md", 2)], "path string, rank int")
    assert [tuple(r) for r in graph.linked_notes(results, g).collect()] == [("b.md", "b", "a.md")]
    assert graph.linked_notes(results.withColumn("rank", F.col("rank") + 5), g).count() == 0
