"""Quality rules (operator 9): base counts, and repetition by suffix arrays.

The words of a group of texts are numbered within their text, and all suffixes
are sorted together by prefix doubling, of which each round sorts only the
suffixes that are still tied.  The ranks of each round give the longest common
prefix of neighbours.  The intervals of that array are the maximal repeated
substrings; their spans are united, text by text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_by_bytes, small_batches, texts_of

#: Repeats of fewer words than this, the base rule's window, don't count.
LEAST = 3
#: A text is not kept if more than this share of its words lies in repeats, or a repeat is longer.
MOST_SHARE, LONGEST = 0.3, 100
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
GROUP_BYTES = 2 << 20


def doubled_ranks(first: np.ndarray, stop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(h, ranks by the first h items, suffixes tied in them) for h = 1, 2, 4 ... until none are tied.

    first: an integer for each item, larger than its equals nowhere in its order;
    ``stop`` ends it early.  Ranks are the places where groups begin.
    """
    order = np.argsort(first, kind="stable")
    held = first[order]
    new = np.concatenate([[True], held[1:] != held[:-1]])
    start = np.flatnonzero(new)
    rank = np.empty(len(first), np.int64)
    sizes = np.diff(np.append(start, len(first)))
    rank[order] = np.repeat(start, sizes)
    tied = order[np.repeat(sizes > 1, sizes)]
    h, n = 1, len(first)
    while True:
        yield h, rank, tied
        if not len(tied) or h >= stop:
            return
        a, b = rank[tied], rank[np.minimum(tied + h, n - 1)]
        by = np.lexsort((b, a)) if n >= 1 << 31 else np.argsort(a * n + b, kind="stable")
        tied, a, b = tied[by], a[by], b[by]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(tied)))
        # within an old group, a new one begins where its first member stands
        old = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        offset = np.arange(len(tied)) - np.repeat(old, np.diff(np.append(old, len(tied))))
        rank = rank.copy()
        rank[tied] = a + np.repeat(offset[start], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2


def repeats(first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per item: the longest repeat that begins there (0 if shorter than ``least``), and whether a 3-item window from there occurs twice."""
    n = len(first)
    levels: list[tuple[int, np.ndarray]] = []
    three, order = np.zeros(n, bool), np.zeros(0, np.int64)
    for h, rank, tied in doubled_ranks(first, n):
        levels.append((h, rank))
        if h == 2 and len(tied):
            key = rank[tied] * n + levels[0][1][np.minimum(tied + 2, n - 1)]
            _, back, size = np.unique(key, return_inverse=True, return_counts=True)
            three[tied] = size[back] > 1
        if h <= least:
            order = tied  # what is tied on h <= least items may share ``least``
    # neighbours in suffix order, among suffixes that share a power of two of at most ``least`` items
    longest = np.zeros(n, np.int64)
    if len(order):
        order = order[np.argsort(levels[-1][1][order], kind="stable")]
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for h, rank in reversed(levels):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            common += h * ((rank[x] == rank[y]) & (x != y))
        common[common < least] = 0
        np.maximum.at(longest, a, common)
        np.maximum.at(longest, b, common)
    return longest, three


def text_rules(texts: list[str], least: int = LEAST) -> dict[str, np.ndarray]:
    """The counts of each text; see quality_rules."""
    raw = [t.encode() for t in texts]
    words = [b.split() for b in raw]  # bytes split at exactly the six ASCII spaces
    lengths = np.array([len(w) for w in words], np.int64)
    chars = [len(t) - sum(map(t.count, SPACES)) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    lines = [[line for line in b.split(b"\n") if line.strip()] for b in raw]
    number = defaultdict(count(1).__next__)
    ids = np.concatenate([np.fromiter(map(number.__getitem__, [*w, None]), np.int64, len(w) + 1) for w in words] or [np.zeros(0, np.int64)])
    # a text's words are its own, and an end that equals nothing follows them
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    own = np.repeat(np.arange(len(texts)), lengths + 1)
    longest, three = repeats(own * (len(number) + 1) + ids, least) if len(ids) else (np.zeros(0, np.int64),) * 2

    def covered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Items of each text that lie in spans."""
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + size, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
        return inside[ends] - inside[starts]

    at3, atl = np.flatnonzero(three), np.flatnonzero(longest)
    peak = np.maximum.reduceat(longest, starts) if len(texts) else longest
    return {
        "n_words": lengths,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": covered(at3, np.full(len(at3), 3)),
        "repeat_words": covered(atl, longest[atl]),
        "longest_repeat": peak,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_words", "longest_repeat")


def quality_rules(docs: DataFrame, least: int = LEAST, most_share: float = MOST_SHARE, longest: int = LONGEST) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``.

    repeat_words is the number of words that lie in a substring of ``least``
    words or more that the text has twice; longest_repeat the longest such one.
    A null or empty text has no words and fails; repeated rows give repeated
    rows; a null doc_id stays null; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", *COUNTS, "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_by_bytes(batches, GROUP_BYTES):
            got = text_rules(texts, least)
            n = got["n_words"]
            failed = (n < 50) | (100 * got["n_repeat_words"] > 50 * n)
            kept = ~failed & (got["repeat_words"] <= most_share * n) & (got["longest_repeat"] <= longest)
            columns = [pa.array(ids, pa.int64()), *(pa.array(got[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept)]
            yield pa.record_batch(columns, names)

    return texts_of(docs).mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean")
