"""Token-id files and their perfect hash against the library and plain dictionaries."""

import io
import json
import random
import struct
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quernel.llm import perfect_hash, token_files as tf
from quernel.llm.token_files import Index, TokenFiles, look_up, scan, token_files, write_token_files
from quernel.llm.word_pieces import load_tokenizer, tokenizer_path

TEXTS = [None, "", " ", "\n", "a\t b", "foo  <|endoftext|> bar", "Don't WE'LL 12 345 ½ 一二", "é É 🙂", "Word, word. x.y 1,2", "ab" * 900, "the quick brown fox " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = "one Two three, vier. fünf 6 <| 一 \n".split(" ")
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)]
    rows = [(i, t, "other", "x") for i, t in enumerate(texts)]
    rows += [(None, "no id", "y", "z"), (None, None, "y", "z"), (3, "\n", "again", "w"), (3, "\n", "again", "w"), (3, "else", "again", "w"), (-7, "below", "", "")]
    rows += [(150, f"copy {i}", "hot", "h") for i in range(200)]  # a third of all rows
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start string").repartition(3)


@pytest.fixture(scope="module")
def encode():
    tokenizer = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def sums(ids):
    return len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_rows_are_those_of_the_library(docs, encode):
    got = [tuple(r) for r in token_files(docs, shards=3).collect()]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((r.doc_id, *sums(encode(r.text))) for r in docs.collect())
    got.sort(key=lambda r: r[1])
    at = 0
    for _, start, n, _ in got:  # one after the other, without gaps
        assert start == at
        at += n
    ids = [d for d, *_ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert token_files(docs.where("false")).count() == 0


def test_distinct_ids_have_fixed_starts(docs, encode):
    once = docs.where("doc_id BETWEEN 0 AND 140 AND doc_id <> 3").dropDuplicates(["doc_id"])
    rows, want, at = sorted(once.collect(), key=lambda r: r.doc_id), [], 0
    for r in rows:
        n, crc = sums(encode(r.text))
        want.append((r.doc_id, at, n, crc))
        at += n
    assert sorted(map(tuple, token_files(once, shards=4).collect())) == want


def test_another_process_reads_the_files(spark, docs, encode, tmp_path):
    path = f"file://{tmp_path}/ids"
    files = write_token_files(docs, path, shards=3)
    assert len(files.shards) > 1
    texts = {i: t for i, t in enumerate(TEXTS)}
    code = f"import json; from quernel.llm.token_files import TokenFiles; f = TokenFiles.open({path!r}); print(json.dumps([f.ids(k) for k in (8, 10, 10**9)]))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    assert json.loads(said.strip().splitlines()[-1]) == [[encode(texts[8])], [encode(texts[10])], []]
    assert sorted(map(len, TokenFiles.open(path).ids(3))) == sorted(len(encode(t)) for t in ("\n", "\n", "\n", "else"))
    assert len(files.ids(150)) == 201
    with pytest.raises(FileExistsError):
        write_token_files(docs, path)
    key = lambda r: (r.start, r.n_tokens)
    assert sorted(scan(spark, files).collect(), key=key) == sorted(look_up(files, docs).collect(), key=key)
    assert [r.doc_id for r in look_up(files, docs.where("doc_id = 5").unionAll(docs.where("doc_id = 5"))).collect()] == [5]
    (tmp_path / "ids" / tf.MANIFEST).unlink()
    with pytest.raises(FileNotFoundError):
        TokenFiles.open(path)


def test_rows_come_from_the_hash(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    files = write_token_files(docs.where("doc_id > 20"), path, shards=1)
    with pytest.raises(Exception, match="no record of doc_id"):
        look_up(files, docs.where("doc_id IN (2, 30)")).collect()
    file = tmp_path / "ids" / f"{files.shards[0]['path']}.idx"
    whole = file.read_bytes()
    with open(file, "rb") as f:
        blocks = Index(f).hash.blocks
    at, size = blocks.at, blocks.n * blocks.dtype.itemsize
    file.write_bytes(whole[:at] + bytes(size) + whole[at + size :])  # the hash without its bits
    with pytest.raises(Exception, match="no record of doc_id"):
        look_up(files, docs.where("doc_id = 30")).collect()
    assert files.ids(30) == []


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_index(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    assert sorted(perfect_hash.PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))
    data = Index.pack([None, *keys.tolist()], [3] * (len(keys) + 1))
    loaded = Index(io.BytesIO(data)).load()
    first, count = loaded.find(keys)
    assert (first == np.arange(1, len(keys) + 1)).all() and (count == 1).all() and (loaded.keys() == keys).all()
    assert not loaded.find(np.arange(2**62 + 1, 2**62 + 500))[1].any()
    for key in keys[:: max(1, n // 20)]:
        file = Counted(data)
        index = Index(file)
        record = index.find(np.array([key]))[0]
        assert record == loaded.find(np.array([key]))[0] and index.spans(record)[0][0] == 3 * record[0]
        assert file.read_bytes < 3500  # the same bound at every size


def test_keys_beyond_the_levels(monkeypatch):
    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    keys = np.arange(-500, 500) * 7
    hashed = perfect_hash.PerfectHash.build(keys)
    assert len(hashed.rest) and sorted(hashed.slots(keys)) == list(range(1000))
    with pytest.raises(ValueError, match="not an index"):
        Index(io.BytesIO(bytes(100)))
