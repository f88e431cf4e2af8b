import pytest
from pyspark.sql import functions as F

from quernel.functions import text as tx
from quernel.functions.frontmatter import first_paragraph, parse
from quernel.operators.chunks import chunks_of, line_cost


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


# a quarter of the plain characters and two thirds of the wide ones, each rounded down, and one
@pytest.mark.parametrize("text, n", [("", 1), ("oak", 1), ("birch", 2), ("a row of elms", 4), ("森", 1), ("森林", 2), ("木々の緑", 3), ("elm 楡 and 樫 oak", 5), ("é" * 8, 3)])
def test_token_estimates(spark, text, n):
    assert line_cost(text) == n
    assert one(spark, text, tx.estimate_tokens) == n


@pytest.mark.parametrize("line, level, text", [("# Trees", 1, "Trees"), ("#### Bark and leaf ", 4, "Bark and leaf"), ("\t## Roots", 2, "Roots"), ("###### ", 6, ""), ("##", 2, ""), ("#oak", 0, ""), ("oak # elm", 0, ""), ("####### too deep", 0, "")])
def test_headings(spark, line, level, text):
    assert one(spark, line, tx.heading_level) == level
    assert one(spark, line, tx.heading_text) == text


def test_titles_tags_and_lines(spark):
    assert one(spark, "grove/old/elm.md.md", tx.file_title) == "elm"
    assert one(spark, ",oak, elm,,", tx.csv_tags) == ["oak", " elm"]
    assert one(spark, "one\r\n\r\ntwo\n", tx.lines) == ["one", "", "two"]
    assert one(spark, "", tx.lines) == []
    assert one(spark, "It's É2-" + "y" * 40 + " Z", tx.tokens) == ["it", "s", "é2", None, "z"]


@pytest.mark.parametrize(
    "content, title, tags, body",
    [
        ("---\ntitle: Elm\ntags:\n  - Bark\n  - leaf\n---\nA tall tree.", "Elm", ["bark", "leaf"], "A tall tree."),
        ("---\ntags: shade\ntitle: Oak\n---\nOld.", "Oak", ["shade"], "Old."),
        ("---\ntags: [Root, STEM]\n---\n", None, ["root", "stem"], ""),
        ("no head at all", None, [], "no head at all"),
        ("", None, [], ""),
        ("---\ntitle: Ash\nit never ends", None, [], "---\ntitle: Ash\nit never ends"),
        ("---\ntitle: {broken\n---\nrest", None, [], "rest"),
        ("---\ntitle: Fir\ntags: 7\n---\nrest", None, [], "rest"),
        ("---\r\ntitle: Yew\r\n---\r\nrest", "Yew", [], "rest"),
    ],
)
def test_frontmatter(content, title, tags, body):
    got = parse(content)
    assert (got[0], got[1], got[6]) == (title, tags, body)


def test_summaries():
    assert parse("---\nsummary: Of trees\n---\nAnother text")[3] == "Of trees"
    assert parse("---\ntitle: Elm\n---\n# Elm\n\nIt grows\nby rivers.\n\nAnd elsewhere")[3] == "It grows by rivers."
    long = first_paragraph("oak " * 100)
    assert long.endswith("...") and len(long) <= 253
    assert first_paragraph("## heading alone\n\n") is None


def test_chunks():
    assert chunks_of("An elm.\nAn oak.", "Trees", 400) == [("An elm.\nAn oak.", 1, 2, None)]
    got = chunks_of("At first\n## Bark\nrough\n### Moss\ngreen\n## Leaf\nsmooth\nand thin", "Elm", 400)
    assert [(a, b, h) for _, a, b, h in got] == [(1, 1, None), (2, 3, "Elm > Bark"), (4, 5, "Elm > Bark > Moss"), (6, 8, "Elm > Leaf")]
    assert chunks_of("", "Elm", 400) == [] and chunks_of(" \n\n", "Elm", 1) == []
    line = "leaf " * 60  # 76 of the budget
    assert [(a, b) for _, a, b, _ in chunks_of("\n".join([line] * 5), "Elm", 160)] == [(1, 2), (3, 4), (5, 5)]
    assert [(a, b) for _, a, b, _ in chunks_of("\n\noak\n# Elm\nash", "T", 100)] == [(1, 3), (4, 5)]
