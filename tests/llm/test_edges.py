"""Odd columns, repeated rows, empty tables and long texts, for operators and pipeline stages."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quernel.llm import line_dedup
from quernel.llm.bpe import bpe_digests
from quernel.llm.chat import format_chats
from quernel.llm.decontaminate import contaminated, drop_contaminated
from quernel.llm.language_id import keep_identified, learn
from quernel.llm.line_dedup import LineDedup, dedup_lines
from quernel.llm.near_dedup import drop_near_copies, near_classes
from quernel.llm.quality import quality_rules

ODD = ["n_lines", "N_Dropped", "keys_0", "a.b", "key", "class_id", "count", "part_", "size", "band", "word`s", "with space", "place", "lost"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The documents with many odd columns, two repeated rows, and rows without a doc_id."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = table.unionAll(table.where("doc_id < 2")).unionAll(table.where("doc_id IN (5, 6)").withColumn("doc_id", F.lit(None).cast("long")))
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    return table.selectExpr("*", *(f"concat('{i}-', doc_id) AS {quoted(n)}" for i, n in enumerate(ODD)))


def rows_of(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def test_line_dedup_with_odd_columns(docs):
    whole = dedup_lines(docs, counted=False)
    assert whole.schema.names == docs.schema.names
    counted = dedup_lines(docs)
    assert counted.schema.names == [n for n in docs.schema.names if n.lower() not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    plain = dedup_lines(docs.select("doc_id", "text"))
    assert rows_of(counted.select("doc_id", "text", "n_lines", "n_dropped")) == rows_of(plain)
    assert rows_of(whole.select("doc_id", "`a.b`", "key")) == rows_of(docs.select("doc_id", "`a.b`", "key"))


def test_near_dedup_with_odd_columns(docs):
    left = drop_near_copies(docs)
    assert left.schema.names == docs.schema.names
    kept = left.where("doc_id IS NOT NULL")
    classes = near_classes(docs.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.class_id for r in classes.select("class_id").distinct().collect())
    assert left.where("doc_id IS NULL").count() == 2


def test_a_doc_id_with_several_texts(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "one text of some words"), (1, "and a second text beside it"), (2, "and a second text beside it"), (3, "one text of some words"), (4, long), (5, long + " more"), (5, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_classes(table).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    assert sum(found[d] == 1 for d in (1, 2, 3)) == 2  # with the copy of whichever text stands for 1
    assert found[5] in (4, 5)
    assert sorted(r.doc_id for r in drop_near_copies(table).collect()) == sorted({*found.values()})


def test_stages_with_odd_columns(spark, docs, sf_dir):
    table = docs.drop("n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, table, sf_dir)
        assert out.schema.names == table.schema.names, name
        assert 0 < out.count() <= table.count()
    tokens = pipeline.STAGES[-1][1](spark, table, sf_dir)
    assert tokens.columns[0] == "doc_id" and tokens.count() == table.count()


def test_stages_of_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (None, "words of no document", "en", "s", 20), (3, "word " * 60_000, "en", "s", 300_000), (3, "word " * 60_000, "en", "s", 300_000), (4, "12 34", "en", None, 5)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = spark.createDataFrame(rows, schema)
    named = dict(pipeline.STAGES)
    assert Counter(r.doc_id for r in named["language_id"](spark, odd, sf_dir).collect()) == {None: 1, 3: 2}
    lines = named["line_dedup"](spark, odd, sf_dir).collect()
    assert Counter(r.doc_id for r in lines) == {1: 1, 2: 1, None: 1, 3: 2, 4: 1} and {r.text for r in lines if r.doc_id == 1} == {""}
    assert Counter(r.doc_id for r in named["near_dedup"](spark, odd, sf_dir).collect()) == {1: 1, 2: 1, None: 1, 3: 1, 4: 1}
    assert named["decontamination"](spark, odd, sf_dir).count() == 6 and named["bpe"](spark, odd, sf_dir).count() == 6
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0, name


def test_lines_that_go_change_n_chars(spark, sf_dir):
    line = "a line that all of these documents share, long enough"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", "en", "s", 1000) for i in range(6)], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.lines(spark, docs, sf_dir).collect()}
    assert got == {i: (f"own {i}", 5) for i in range(5)} | {5: (f"{line}\nown 5", 1000)}


def test_documents_without_labels_are_an_error(spark):
    rows = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert learn(rows) is None
    with pytest.raises(ValueError, match="no labelled document"):
        keep_identified(rows)
    assert keep_identified(rows.where("false")).count() == 0


def line_tables(state):
    return sorted(map(tuple, state.lines.collect())), sorted(map(tuple, state.counts.collect()))


def test_inserting_again_counts_once(spark):
    rows = [(i, f"the line that they all share, longer than forty\nline {i} alone, which is long enough to be counted") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state = LineDedup(spark).insert(docs)
    before = line_tables(state)
    state.insert(docs)
    assert line_tables(state) == before and {r.n_docs for r in state.counts.collect()} == {1, 4}
    assert {r.n_dropped for r in state.clean(docs).collect()} == {0}
    changed = spark.createDataFrame([(0, "nothing")], "doc_id long, text string")
    assert max(r.n_docs for r in state.insert(changed).counts.collect()) == 3


def test_filters_grow_with_their_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    table = lambda lo, hi: spark.createDataFrame([(i, "\n".join(f"common line number {k} of many, long enough to count" for k in range(lo, hi))) for i in range(lo, lo + 5)], "doc_id long, text string")
    state = LineDedup(spark).insert(table(0, 3))
    assert state.shards == 1
    state.insert(table(10, 40))
    assert state.shards >= 8 and state.filters.count() <= state.shards
    both = table(0, 3).unionByName(table(10, 40))
    assert rows_of(state.clean(both)) == rows_of(dedup_lines(both))


def plain_chats(rows):
    turns = defaultdict(set)
    for c, t, role, text in rows:
        turns[c].add((t, role, text))
    chats = defaultdict(list)
    for c, held in turns.items():
        chats[tuple((role, text) for _, role, text in sorted(held))].append(c)
    return {
        (min(c), len(k), len(c), "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in k))
        for k, c in chats.items()
        if not any(len(o) > len(k) and o[: len(k)] == k for o in chats)
    }


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_collapse_as_by_hand(spark, seed):
    rng = random.Random(seed)
    rows, chats = [], []
    for _ in range(40):  # a third of all conversations begin alike
        start = [("user", "hello")] if rng.random() < 0.4 else []
        chats.append(start + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "x" * 50_000, ""])) for _ in range(rng.randint(1, 4))])
    for c in range(200):
        whole = rng.choice(chats)
        cut = whole[: rng.randint(1, len(whole))]
        rows += [(c, 10 * i, *t) for i, t in enumerate(cut)] + [(c, 0, *cut[0])] * (c % 3 == 0)
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, a string, p string, n int")
    got = [tuple(r) for r in format_chats(table).collect()]
    want = plain_chats(rows)
    assert len(got) == len(want) < 120 and set(got) == want


def test_empty_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60)) + " " + "tail " * 3
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "y"), (2, None, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    for make in (quality_rules, bpe_digests):
        got = make(table)
        assert Counter(r.doc_id for r in got.collect()) == {1: 2, None: 1, 2: 1}
        assert make(table.where("false")).count() == 0 and make(table.where("false")).columns == got.columns
    assert {(r.n_words, r.kept) for r in quality_rules(table).collect()} == {(63, True), (0, False)}


def test_repeated_documents_and_items(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in "mnprst"]
    item = " ".join(rng.sample(words, 40))
    rows = [(1, f"{item} and more", "i"), (1, f"{item} and more", "i"), (None, item, "i"), (2, " ".join(rng.sample(words, 60)), "i"), (3, None, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "x")], "item_id long, text string, doc_id string")
    assert Counter((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == {(1, 7): 2, (None, 7): 1}
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [2, 3]
