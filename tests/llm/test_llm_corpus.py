"""Chat collapse, URL filter, deduplication, decontamination and the pipeline against plain versions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import bag_minhash as bag
from quernel.llm import catalog
from quernel.llm.chat import format_chats
from quernel.llm.components import components
from quernel.llm.decontaminate import common_length, contaminated, drop_contaminated, leading
from quernel.llm.line_dedup import Cuckoo, LineDedup, line_digests, line_keys
from quernel.llm.near_dedup import drop_near_copies, near_classes
from quernel.llm.url_filter import fit, filter_urls, labelled_urls

DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_covers_its_table(name, spark, sf_dir):
    found = catalog.QUERIES[name](spark, sf_dir)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    if name != "op5_decontaminate":
        assert found.count() == spark.read.parquet(f"{sf_dir}/{'pages' if key == 'page_id' else 'documents'}.parquet").count()


# Chats.


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, None, None, None), (None, 0, "user", "lost"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_chats(table).collect()}
    assert set(got) == {2, 4, 5}  # 1 and 6 are prefixes, 3 is a copy
    assert (got[2].n_turns, got[2].n_logged) == (2, 2)
    assert got[2].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n" and got[5].rendered == "<|unknown|>\n\n<|end|>\n"
    assert format_chats(table.where("false")).count() == 0


# URLs.


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(i for c in "/?#" if (i := rest.find(c)) >= 0)])
    tail = rest[cut:]
    end = min([len(tail), *(i for c in "?#" if (i := tail.find(c)) >= 0)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def plain_rule(host, path):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    fits = [r for r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fits, key=len, default=None)
    return best, rules.get(best)


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/en/12?x#y", "https://example.org/es/1", "https://example.org/es", "x://y.com/fr/://z", "http://notexample.org", "http://q.com/de/?a/b", "http://É.net#/p", "http://best.casino-win.example.net/en/5", "http://library.example.net/en/5", "http://h.net/" + "a" * 50_000, "://", "a\nb://c.com/fr/x\ny"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, host string")
    got = filter_urls(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path) == plain_url(urls[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    by = {urls[r.page_id]: r.verdict for r in got}
    assert by[urls[10]] == "block" and by[urls[11]] == "allow"
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled_urls())], "page_id long, url string")
    right = [("block" if labelled_urls()[r.page_id][1] else "allow") == ("block" if r.score >= 0.5 else "allow") for r in filter_urls(table).collect()]
    assert np.mean(right) > 0.95
    assert fit(spark) == fit(spark)
    assert filter_urls(pages.where("false")).count() == 0


# Lines.


def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or d == max(holders[key(x)])]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_rows():
    rng = random.Random(4)
    pool = ["A common line that is quite long, number %d É" % i for i in range(6)] + ["é" * 39, "é" * 40, "short"]
    rows = [(i, "\n".join(rng.choice(["", "  ", "\t", "\xa0"]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice(["", "\r", " "]) for x in rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "\n".join([pool[0]] * 2000)), (63, "x" * 100_000)]


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, keys_0 string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digests(docs).collect()}
    assert got == plain_lines(rows) and sum(v[1] for v in got.values()) > 50
    assert line_digests(docs.where("false")).count() == 0
    cleaned = LineDedup(spark).insert(docs).clean(docs)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_dropped"] and cleaned.count() == len(rows)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.n_dropped for r in LineDedup(spark).insert(nameless).clean(nameless).collect()} == {0}


def test_insertions_can_be_taken_back(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], DOCS)
    first, second = docs.where("doc_id < 30"), docs.where("doc_id >= 30")
    tables = lambda s: (sorted(map(tuple, s.lines.collect())), sorted(map(tuple, s.counts.collect())))
    state = LineDedup(spark, shards=2).insert(first)
    before = tables(state)
    state.insert(second)
    assert {r.doc_id: r.n_dropped for r in state.clean(docs).collect()} == {d: v[1] for d, v in plain_lines(rows).items()}
    whole = tables(LineDedup(spark, shards=2).insert(docs))
    assert tables(state) == whole
    state.delete(second)
    assert tables(state) == before
    assert {r.doc_id: r.n_dropped for r in state.clean(first).collect()} == {d: v[1] for d, v in plain_lines(rows[:30]).items()}
    frequent = {r.b for r in state.counts.where("n_docs >= 5").collect()}
    held = [Cuckoo.load(bytes(r.filter)) for r in state.filters.collect()]
    assert sum(int((t != 0).sum()) for c in held for t in c.tables) == len(frequent)
    assert line_keys(docs.where("doc_id IS NULL")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500, 40_000])
def test_cuckoo(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    cuckoo = Cuckoo()
    for part in np.array_split(keys, 3):
        cuckoo.insert(part)
    cuckoo = Cuckoo.load(cuckoo.dump())
    assert cuckoo.contains(keys).all()
    others = np.random.default_rng(9).integers(-(2**62), 2**62, 20_000)
    assert cuckoo.contains(others).mean() < 0.01
    cuckoo.delete(keys[:300])
    assert cuckoo.contains(keys[300:]).all() and cuckoo.contains(keys[:300]).sum() <= 0.1 * min(n, 300)


# Near copies.


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = {i: int(rng.integers(1, 40)) for i in range(40)}
    b = {i: (v if rng.random() < 0.6 else int(rng.integers(1, 60))) for i, v in a.items()}
    want = sum(min(a[i], b[i]) for i in a) / sum(max(a[i], b[i]) for i in a)
    agree = []
    for t in range(80):
        row = lambda w, t=t: bag.signatures(np.zeros(len(w), np.int64), bag.mix(np.array([i * 1000 + t for i in w], np.uint64)), np.array(list(w.values())), 1)[0]
        agree.append((row(a) == row(b)).mean())
    assert abs(np.mean(agree) - want) < 4 * math.sqrt(want * (1 - want) / (80 * bag.SLOTS))


def plain_classes(rows, least=0.8):
    hashes = bag.WordHashes()
    keys = sorted({" ".join(t.split()) for _, t in rows if t and t.split()})
    sets = {k: bag.multiset(k.encode(), hashes) for k in keys}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bag.overlap(sets[a], sets[b]) >= least:
                root[find(a)] = find(b)
    members = defaultdict(list)
    for d, t in rows:
        if d is not None:
            members[find(" ".join(t.split())) if t and t.split() else d].append(d)
    return {d: min(v) for v in members.values() for d in v}


def near_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "two words"), (4, "two  words"), (5, "two other"), (6, "a " * 300), (7, "a " * 290), (8, "a " * 100)]
    shared = [word() for _ in range(60)]
    for family in range(6):
        base = [word() for _ in range(rng.choice([40, 200]))] + shared
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), " ".join(word() for _ in range(50_000)))]


def test_near_classes(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    want = plain_classes(rows)
    assert {r.doc_id: r.class_id for r in near_classes(docs).collect()} == want
    again = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(None, "no id", "x")], docs.schema))
    kept = [r.doc_id for r in drop_near_copies(again).collect()]
    assert sorted(kept, key=str) == sorted([*{*want.values()}, None], key=str)
    assert near_classes(docs.where("false")).count() == 0 and drop_near_copies(docs.where("doc_id < 3")).count() == 3


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: n for p in pairs for n in p}
    for _ in range(60):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


# Benchmarks.


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfghjk") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(20, 50)).capitalize() + ". " + text(8) + ".") for i in range(30)] + [(30, None), (31, ""), (None, text(25))]
    rows, want = [(0, None), (1, ""), (2, "word")], set()
    for d in range(3, 90):
        body = text(rng.randint(0, 300))
        if d % 3 == 0:
            item = items[d % 30]
            part = item[1].split()
            if d % 2:
                part = [w if rng.random() > 0.1 else text(1) for w in part]  # a paraphrase
            at = rng.randrange(len(body) + 1)
            body = body[:at] + "\n" + " ".join(part).upper() + "\n" + body[at:]
            want.add((d, item[0]))
        rows.append((d, body))
    rows.append((90, text(30_000) + " " + items[5][1] + " " + text(30_000)))
    rows.append((91, items[32][1]))
    want |= {(90, 5), (91, None)}
    docs, benchmark = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    assert found == want
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert contaminated(docs, benchmark.where("false")).count() == 0 and contaminated(docs.where("false"), benchmark).count() == 0
    assert drop_contaminated(docs, benchmark.where("item_id >= 30")).count() == len(rows)


def test_decontamination_without_the_rarest_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfghjk") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    items = [(i, " ".join(rng.sample(words, 50))) for i in range(20)]
    docs = [(d, " ".join(rng.choices(words, k=300))) for d in range(100, 140)]
    spread = defaultdict(int)
    for text in [t for _, t in docs + items]:
        for w in set(text.split()):
            spread[w] += 1
    for i, text in items:
        rarest = set(sorted(text.split(), key=lambda w: (spread[w], w))[:12])
        body = [f"zz{n}" if w in rarest else w for n, w in enumerate(text.split())]
        docs.append((i, " ".join([*rng.choices(words, k=70), *body, *rng.choices(words, k=90)])))
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    found = {(r.doc_id, r.item_id) for r in contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, i) for i, _ in items}


def test_decontamination_with_the_answer(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfghjk") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    items, docs = [], []
    for i in range(20):
        body, answer = rng.sample(words, 36), rng.sample(words, 4)
        items.append((i, " ".join(body) + ". " + " ".join(answer) + "."))
        lost = set(rng.sample(range(36), 18))  # 22 of 40 words stay
        kept = [f"zz{n}" if n in lost else w for n, w in enumerate(body)]
        around = [rng.choices(words, k=60) for _ in range(2)]
        docs.append((i, " ".join([*around[0], *kept, *answer, *around[1]]), "x"))
        docs.append((i + 100, " ".join([*around[0], *kept, *around[1]]), "x"))  # too little without the answer
    found = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, i) for i, _ in items}


def test_common_subsequences():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_length(a, b) == table[-1][-1]


def test_leading_vectors():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((200, 8)) @ rng.standard_normal((8, 60))
    omega = rng.standard_normal((60, 20))
    basis = leading(a.T @ a @ omega, omega, 8)
    assert basis.shape == (60, 8) and np.allclose(a @ basis @ basis.T, a, atol=1e-3)


# The pipeline.


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, table, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        rows = {r.doc_id: r.text for r in out.collect()}
        before = {r.doc_id: r.text for r in table.collect()}
        assert set(rows) <= set(before)
        if name == "language_id":
            assert set(before) - set(rows) == {d for d, t in before.items() if not any(map(str.isalpha, t or ""))}
        if name == "line_dedup":
            want = plain_lines(list(before.items()))
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows.items()} == {d: v[2] for d, v in want.items()}
        if name == "near_dedup":
            assert set(rows) == {d for d, c in plain_classes(list(before.items())).items() if d == c}
        table = spark.createDataFrame(out.collect(), docs.schema)
    last = {r.doc_id: r.n_tokens for r in p.STAGES[-1][1](spark, table, sf_dir).collect()}
    assert last == {r.doc_id: r.n_tokens for r in p.run(spark, sf_dir).collect()} and set(last) == {r.doc_id for r in table.collect()}
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5
