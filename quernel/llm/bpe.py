"""BPE encoding and decoding (operator 7) with contiguous rank arrays.

A word is held as three contiguous lists: part ids, part boundaries, and the
ranks of adjacent parts.  The smallest rank is looked for again and again; its
two parts become one, the boundary between them goes, and the two neighbouring
ranks are refreshed.  Words too long for repeated scans use a heap over linked
parts, with the same order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from .common import Memo, held, rows_by_bytes, small_batches, texts_of
from .word_pieces import tokenizer_path

# Fixed value: the pre-tokenisation pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = 1 << 60
#: Words with more bytes than this use the heap.
LONG_WORD = 400
#: Up to here every version of the Unicode tables has the same letters and numbers.
LATIN_END = "\u0250"
#: Chunks longer than this are not kept.
LONGEST_KEPT = 128
KEPT = 300_000
BATCH_BYTES = 1 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class RankArrayBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank_of[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self.pieces = regex.compile(PATTERN).findall
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        names = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        #: Cut where a space or line feed follows something else.
        self.chunks = regex.compile(r"[ \n]*+[^ \n]++|[ \n]++").findall
        self.memo = Memo(lambda keys: [self._ids(k) for k in keys], KEPT)

    def word(self, word: bytes) -> tuple[list[int], list[int]]:
        """Ids of the parts of ``word``, and where each part starts."""
        ids = list(map(self.byte_id.__getitem__, word))
        if len(ids) > LONG_WORD:
            return self._long(ids)
        bounds = list(range(len(ids)))
        rank_of, merged = self.rank_of, self.merged
        ranks = [rank_of.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of.get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank_of.get(ids[i] << 20 | ids[i + 1], NONE)
        return ids, bounds

    def _long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        n, rank_of = len(ids), self.rank_of
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pair = lambda i: rank_of.get(ids[i] << 20 | ids[after[i]]) if after[i] >= 0 else None
        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            rank, i = heapq.heappop(heap)
            if gone[i] or pair(i) != rank:
                continue
            j = after[i]
            ids[i], gone[j], after[i] = self.merged[rank], 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        kept = [i for i in range(n) if not gone[i]]
        return [ids[i] for i in kept], kept

    def _plain(self, text: str) -> list[int]:
        """Ids of a text, all of it worked on afresh."""
        out: list[int] = []
        for i, part in enumerate(self.cut(text) if self.cut else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                for piece in self._pieces(part):
                    out += self.word(piece.encode())[0]
        return out

    def _ids(self, chunk: str):
        """Ids of a chunk as bytes; False where its end isn't a safe boundary (odd white space)."""
        if chunk[-1].isspace() and chunk[-1] not in " \n":
            return False
        if self.cut and any(name in chunk for name in self.special):
            return array("I", self._plain(chunk)).tobytes()
        known, ids = self.memo.young, b""
        for piece in self._pieces(chunk):
            ids += known.get(piece) or array("I", self.word(piece.encode())[0]).tobytes()
        return ids

    def _pieces(self, text: str) -> list[str]:
        """Words of a text, without special tokens; the library's split where Unicode tables may differ."""
        if text.isascii() or max(text) < LATIN_END:
            return self.pieces(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        got = list(map(self.memo.young.get, chunks))
        if None in got:
            missing = {c for c, v in zip(chunks, got) if v is None}
            once = {c for c in missing if len(c) > LONGEST_KEPT}
            now = {c: self._ids(c) for c in once}
            self.memo.fill(missing - once)
            young = self.memo.young
            got = [v if v is not None else young[c] if c in young else now[c] for c, v in zip(chunks, got)]
        if False in got:
            return self._plain(text)
        return np.frombuffer(b"".join(got), np.uint32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def worker_bpe(path: str) -> RankArrayBPE:
    """The worker's encoder."""
    return held(("bpe", path), lambda: RankArrayBPE(path))


def bpe_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids, decoded for every row of ``docs``; see bpe_digests for the edge cases."""
    return _encoded(
        docs, vocabulary, "ids array<int>, decoded string",
        lambda ids, text: (ids, text), [pa.list_(pa.int32()), pa.string()],
    )


def bpe_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``.

    A null or empty text has no ids and an empty decoded text; special tokens'
    strings within a text become those tokens; repeated rows give repeated rows;
    a null doc_id stays null; other columns are ignored.
    """
    return _encoded(
        docs, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", None,
        [pa.int64(), pa.string(), pa.string()],
    )


def _encoded(docs: DataFrame, vocabulary: str, schema: str, row, types: list) -> DataFrame:
    small_batches(docs.sparkSession)
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer_path(vocabulary))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for ids, texts in rows_by_bytes(batches, BATCH_BYTES):
            out = []
            for text in texts:
                got = bpe.encode(text)
                if row:
                    out.append(row(got, bpe.decode(got)))
                else:
                    digits = ",".join(map(bpe.digits.__getitem__, got)).encode()
                    out.append((len(got), sha(digits), sha(bpe.decode(got).encode())))
            columns = zip(*out)
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return texts_of(docs).mapInArrow(run, f"doc_id long, {schema}")
