"""Language ID (operator 8): a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between
the labels of neighbouring words are learned too.  Training sequences splice
runs of words of different languages, so that the field labels code-switched
text.  Forward-backward gives each word's label probabilities; a text's language
is the one with the largest mean, which is its score.

Long texts are cut into blocks of words for speed only: the blocks' transfer
matrices carry the messages across, so the result is that of the whole chain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_by_bytes, small_batches, texts_of

#: The bounded sample to learn from: documents a language (about), and the characters of each at most.
SAMPLE, SAMPLE_CHARS = 100, 20_000
#: Features that are kept at most, and words in each language's lexicon.
FEATURES, LEXICON = 60_000, 1_500
SPLICE, LENGTH, STEPS = 40, 200, 40
BLOCK, GROUP_BYTES, KEPT = 128, 1 << 20, 300_000
UNKNOWN = "und"


def core(token: str) -> str:
    """The letters of a token, lower-cased."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def names(word: str) -> list[str]:
    """A word's affix and n-gram features; the word itself stands for the lexicons."""
    w = f"^{word}$"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    return ["", "=" + word, "<" + word[:1], "<" + word[:2], "<" + word[:4], ">" + word[-1:], ">" + word[-2:], ">" + word[-4:], *grams]


class Features:
    """Words to rows of weights."""

    def __init__(self, row: dict[str, int], lexicons: list[set[str]]):
        self.row, self.lexicons = row, lexicons

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words, one after the other, and where each word's begin."""
        flat, starts, get, lexicons = [], [], self.row.get, self.lexicons
        for word in words:
            starts.append(len(flat))
            flat += [i for i in map(get, names(word)) if i is not None]
            flat += [get(f"#{k}") for k, lexicon in enumerate(lexicons) if word in lexicon]
        return np.array(flat, np.int64), np.array(starts, np.int64)


class Field:
    """The fitted field: labels, feature weights, transitions and start weights."""

    def __init__(self, labels: list[str], features: Features, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.labels, self.features = labels, features
        self.weights, self.moves, self.start = weights.astype(np.float32), moves, start

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, starts = self.features.of(words)
        return _sums(self.weights, flat, starts)


def _sums(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each word's weights added up, over the root of their number."""
    size = np.diff(np.append(starts, len(flat)))
    return np.add.reduceat(weights[flat], starts, axis=0) / np.sqrt(size)[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def messages(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at each word, each scaled; e: emission factors of all sequences' words, in order."""
    k, n = e.shape[1], len(e)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    seq = np.repeat(np.arange(len(lengths)), blocks)
    part = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(BLOCK, lengths[seq] - part * BLOCK)
    begin = (np.cumsum(lengths) - lengths)[seq] + part * BLOCK
    first = part == 0
    by = np.argsort(-size, kind="stable")  # the blocks that reach a step come first
    size_b, begin_b, first_b = size[by], begin[by], first[by]
    live = [int(np.searchsorted(-size_b, -t, side="left")) for t in range(BLOCK + 1)]  # blocks with size > t

    # transfer matrices, only where a text has several blocks
    into, out = np.tile(start, (len(seq), 1)), np.ones((len(seq), k))
    if len(seq) > len(lengths):
        m = np.tile(np.eye(k), (len(seq), 1, 1))
        for t in range(BLOCK):
            if not (c := live[t]):
                break
            x = m[:c] if t == 0 else (m[:c].reshape(-1, k) @ moves).reshape(c, k, k)
            if t == 0:
                x = np.where(first_b[:c, None, None], x, moves)
            x = x * e[begin_b[:c] + t][:, None, :]
            m[:c] = x / x.max(axis=(1, 2), keepdims=True)
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        m = m[back]
        head = np.cumsum(blocks) - blocks
        for j in range(int(blocks.max()) - 1):
            s = np.flatnonzero(blocks > j + 1)
            into[head[s] + j + 1] = _unit(np.einsum("bi,bij->bj", into[head[s] + j], m[head[s] + j]))
        for j in range(int(blocks.max()) - 2, -1, -1):
            s = np.flatnonzero(blocks > j + 1)
            out[head[s] + j] = _unit(np.einsum("bij,bj->bi", m[head[s] + j + 1], out[head[s] + j + 1]))
    into, out = into[by], out[by]

    alpha = np.empty((n, k))
    at = into
    for t in range(BLOCK):
        if not (c := live[t]):
            break
        x = at[:c] @ moves if t else np.where(first_b[:c, None], at[:c], at[:c] @ moves)
        at = _unit(x * e[begin_b[:c] + t])
        alpha[begin_b[:c] + t] = at
    beta, at = np.empty((n, k)), out.copy()
    for t in range(BLOCK - 1, -1, -1):
        if not (c := live[t]):
            continue
        here = begin_b[:c] + t
        beta[here] = at[:c]
        if t:
            at[:c] = _unit((e[here] * at[:c]) @ moves.T)
    return alpha, beta


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward."""
    alpha, beta = messages(e, lengths, moves, start)
    return _unit(alpha * beta)


def fit(samples: list[tuple[str, list[str]]], seed: int = 7) -> Field | None:
    """Fits the field to (language, words) of whole texts; None if there are none."""
    labels = sorted({lang for lang, words in samples if words})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    counts = [Counter() for _ in labels]
    for lang, words in samples:
        if words:
            counts[labels.index(lang)].update(words)
    lexicons = [{w for w, c in sorted(x.items(), key=lambda y: (-y[1], y[0]))[:LEXICON] if c > 2} for x in counts]
    vocabulary = sorted(set().union(*counts))
    seen = Counter()
    for w in vocabulary:
        seen.update(set(names(w)))
    kept = sorted((f for f, c in seen.items() if c > 1 or not f), key=lambda f: (-seen[f], f))[: FEATURES - k]
    features = Features({f: i for i, f in enumerate([*kept, *(f"#{j}" for j in range(k))])}, lexicons)
    place = {w: i for i, w in enumerate(vocabulary)}

    # runs of each language, dealt out in random order into sequences
    runs = []
    for lang, words in samples:
        at = 0
        while at < len(words):
            size = int(rng.integers(SPLICE // 2, 2 * SPLICE))
            runs.append((labels.index(lang), [place[w] for w in words[at : at + size]]))
            at += size
    rng.shuffle(runs)
    word = np.array([w for _, run in runs for w in run], np.int64)
    gold = np.array([lang for lang, run in runs for _ in run], np.int64)
    lengths = np.full(-(-len(word) // LENGTH), LENGTH)
    lengths[-1] = len(word) - LENGTH * (len(lengths) - 1)
    inner = np.ones(len(word), bool)
    inner[::LENGTH] = False
    at = np.flatnonzero(inner)
    flat, starts = features.of(vocabulary)
    root = np.sqrt(np.diff(np.append(starts, len(flat))))
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(starts, len(flat))))
    truth_moves = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)

    weights, moves = np.zeros((len(features.row), k)), np.zeros((k, k))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, moves)]
    for step in range(1, STEPS + 1):
        score = _sums(weights, flat, starts)[word]
        e = np.exp(score - score.max(axis=1, keepdims=True))
        a = np.exp(moves)
        alpha, beta = messages(e, lengths, a, np.ones(k))
        p = _unit(alpha * beta)
        x = alpha[at - 1][:, :, None] * a * (e[at] * beta[at])[:, None, :]
        pairs = (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p[np.arange(len(p)), gold] -= 1
        by_word = np.stack([np.bincount(word, p[:, j], len(vocabulary)) for j in range(k)], 1) / root[:, None]
        grads = (
            np.stack([np.bincount(flat, by_word[owner, j], len(weights)) for j in range(k)], 1) / len(word) + 1e-6 * weights,
            (pairs - truth_moves) / len(word) + 1e-4 * moves,
        )
        for x, g, (m, v) in zip((weights, moves), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(labels, features, weights, np.exp(moves), np.ones(k))


class Labeller:
    """Texts to language and score, with the emissions of words memoised."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, len(self.field.labels)), np.float32)
        self.used = 0

    def add(self, tokens: set[str]) -> None:
        cores = {t: core(t) for t in tokens}
        known = {c: self.place[c] for c in set(cores.values()) if c in self.place}
        todo = [c for c in set(cores.values()) if c and c not in known]
        if todo:
            if len(self.table) < (need := self.used + len(todo)):
                self.table = np.concatenate([self.table[: self.used], np.empty((2 * need - self.used, self.table.shape[1]), np.float32)])
            self.table[self.used : need] = self.field.emissions(todo)
            known |= {c: self.used + i for i, c in enumerate(todo)}
            self.used = need
        self.place.update((c, known[c]) for c in todo)
        self.place.update((t, known[c] if c else -1) for t, c in cores.items())

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.place) > KEPT:
            self.clear()
        rows = []
        for text in texts:
            tokens = text.split()
            got = list(map(self.place.get, tokens))
            if None in got:
                self.add({t for t, i in zip(tokens, got) if i is None})
                got = list(map(self.place.__getitem__, tokens))
            row = np.array(got, np.int64)
            rows.append(row[row >= 0])
        lengths = np.array([len(r) for r in rows], np.int64)
        some = np.flatnonzero(lengths)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if len(some):
            score = self.table[np.concatenate(rows)].astype(np.float64)
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = marginals(e, lengths[some], self.field.moves, self.field.start)
            starts = np.cumsum(lengths[some]) - lengths[some]
            mean = np.add.reduceat(p, starts, axis=0) / lengths[some][:, None]
            best = mean.argmax(axis=1)
            for i, b, s in zip(some.tolist(), best.tolist(), mean[np.arange(len(best)), best].tolist()):
                out[i] = (self.field.labels[b], min(1.0, s))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame) -> Field | None:
    """Fits the field to about SAMPLE documents a language: those that aren't held out, and of each the words within SAMPLE_CHARS characters."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in usable.select("lang").groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (SAMPLE << 30) // n + 1))).otherwise(share)
    drawn = usable.where(draw < share).select("lang", F.left("text", F.lit(SAMPLE_CHARS + 1)).alias("text"), draw.alias("draw"), "doc_id")
    rows = drawn.orderBy("draw", "doc_id", "text").limit(2 * SAMPLE * len(counts)).collect()
    return fit([(r.lang, [c for t in _leading_words(r.text) if (c := core(t))]) for r in rows])


def _leading_words(text: str) -> list[str]:
    """The words within SAMPLE_CHARS characters; one that is cut goes, unless it is the only one."""
    tokens = text.split()
    return tokens[:-1] or tokens if len(text) > SAMPLE_CHARS else tokens


SCHEMA = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if no row can be learned from.  Repeated rows give repeated rows;
    a null doc_id counts as held out; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field or learn(docs))  # FEATURES rows of weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for ids, texts in rows_by_bytes(batches, GROUP_BYTES):
            got = labeller.label(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return texts_of(docs).mapInArrow(run, SCHEMA).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, field: Field | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least`` or more.

    Rejected: null texts, texts without a letter, and texts of which no language
    has that share of the words' probability.  A table with rows of which none
    can be learned from (no text with a lang that isn't held out) is an error,
    since nothing could be told apart; an empty one gives an empty one.  Other
    columns, repeated rows and null ids stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    field = field or learn(docs)
    if field is None:
        if not docs.isEmpty():
            raise ValueError("no labelled document to learn languages from")
        return docs
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            got = labeller.label([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_()))

    return map_rows(docs, run)
