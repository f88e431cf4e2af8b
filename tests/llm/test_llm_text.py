"""Token counts, BPE, token files, quality rules and language ID against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quernel.llm.bpe import LONG_WORD, RankArrayBPE, bpe_digests, bpe_tokens
from quernel.llm.language_id import Field, Labeller, core, fit, held_out, identify, keep_identified, learn, marginals
from quernel.llm.quality import quality_rules, text_rules
from quernel.llm.token_counts import token_counts
from quernel.llm.word_pieces import load_tokenizer, segments, tokenizer_path

ODD = [None, "", " ", "\n", "a\t b", "a\t\n b", "x  y  ", "<|endoftext|>", "foo  <|endoftext|> bar<|startoftext|>", "Don't WE'LL 12 345 ½ ² 一二", "e\u0301 É", "a\x1c b\x85 c", "🙂🙂 a", "\r\n\r\n a", "Word, word. WORD,. x.y 1,2", "ab" * 900, "the quick brown fox " * 3000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = [*" \n\t'sabcTL<|>éñ09,.-", "\u3000", "一", "🙂", "<|endoftext|>", "'ll"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "other", "x") for i, t in enumerate(texts)] + [(None, "no id", "y", "z"), (3, "\n", "again", "w"), (3, "\n", "again", "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, lang string").repartition(3)


def test_token_counts(docs):
    tokenizer = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, token_counts(docs).collect())) == want
    assert token_counts(docs.where("false")).count() == 0


def test_counts_of_a_tokenizer_that_keeps_spaces(docs):
    library = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts(docs, "byte_bpe_50k.json").collect()) == want


def test_segments_are_the_text():
    text = "ab cd\nef " * 50
    parts = list(segments(text, 20))
    assert "".join(parts) == text and len(parts) > 5 and list(segments("x" * 100, 7)) == ["x" * 100]


def test_bpe(docs, texts):
    library = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe_digests(docs).collect())) == want
    assert all(r.decoded == (texts[r.doc_id] or "") for r in bpe_tokens(docs).collect() if r.doc_id is not None)


def test_long_words_merge_in_the_same_order():
    bpe = RankArrayBPE(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(30):
        word = "".join(rng.choice("abcéthein") for _ in range(rng.randint(LONG_WORD // 4, LONG_WORD // 2))).encode()
        ids, bounds = bpe.word(word)
        assert bpe._long(list(map(bpe.byte_id.__getitem__, word))) == (ids, bounds)
        assert b"".join(map(bpe.bytes_of.__getitem__, ids)) == word
        assert [word[a:b] for a, b in zip(bounds, [*bounds[1:], len(word)])] == [bpe.bytes_of[i] for i in ids]


def plain_rules(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, longest = len(words), 0
    lies, lies3 = [0] * n, [0] * n
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            longest = max(longest, best)
            lies[i : i + best] = [1] * best
        if best >= 3:
            lies3[i : i + 3] = [1] * 3
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(lies3), sum(lies), longest


def test_quality_rules(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a " * 40, "\x1c a\xa0b \x85"]
    for _ in range(150):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[: rng.choice([2, 3, 8, 40])]) for _ in range(rng.randint(0, 70))]
        texts.append("".join(w + rng.choice([" ", "\n", " \t", "#"]) for w in words + words[5:18]))
    for least in (3, 4, 10):
        got = text_rules([t or "" for t in texts], least)
        assert list(zip(*(v.tolist() for v in got.values()))) == [plain_rules(t, least) for t in texts]
    found = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 0.3, 9).collect()
    for r in found:
        n, chars, symbols, lines, three, covered, longest = plain_rules(texts[r.doc_id], 4)
        failed = n < 50 or 100 * three > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, three, failed)
        assert r.kept == (not failed and covered <= 0.3 * n and longest <= 9)
    assert text_rules([], 3)["n_words"].size == 0


def plain_marginals(e, moves, start):
    n, k = e.shape
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        alpha[t] = (start if t == 0 else alpha[t - 1] @ moves) * e[t]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = moves @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_over_blocks():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 127, 128, 129, 700, 2, 256])
    e, moves, start = rng.random((lengths.sum(), 3)) + 0.01, rng.random((3, 3)) + 0.05, np.ones(3)
    got, at = marginals(e, lengths, moves, start), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], plain_marginals(e[at : at + n], moves, start))
        at += n


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    field = learn(docs)
    joined = identify(docs, field).join(docs, "doc_id").where("held_out").collect()
    assert len(joined) > 150 and sum(r.lang_pred == r.lang for r in joined) / len(joined) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in joined)
    by = {r.lang: r.text for r in joined if len(r.text) > 500}
    mixed = Labeller(field).label([by["en"][:400] + " " + by["fr"][:150]])[0]
    assert mixed[0] == "en" and mixed[1] < 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 !!", "en"), (None, by["de"], None), (4, "the " * 50_000, "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(odd, field).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "de" and got[None].held_out
    assert got[4].lang_pred == "en"
    assert {r.doc_id for r in keep_identified(odd, field=field).collect()} == {None, 4}
    assert {r.lang_pred for r in identify(odd.withColumn("lang", odd.lang.substr(9, 1)).where("lang IS NULL")).collect()} == {"und"}
    assert identify(odd.where("false")).count() == 0 and fit([]) is None and core("D'où!") == "doù" and isinstance(field, Field) and held_out is not None
