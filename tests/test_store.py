"""Versions of the index, what reads them, and the tool surfaces."""

import io
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quernel import config as settings
from quernel.config import Config
from quernel.functions.embed import HashingEmbedder
from quernel.plans import index
from quernel.plans.engine import Engine
from quernel.plans.index import Store, refresh
from quernel.server import serve
from quernel.streaming import watch as watching

TABLES = ("notes", "manifest", "vectors", "postings", "lengths", "links")
SETTINGS = Config().validated()


def notes(spark, texts):
    rows = [(p, t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, content string").withColumn("modified", F.lit("2024-05-01").cast("timestamp"))


def contents(store):
    return {n: sorted(map(str, store.table(n).collect())) for n in TABLES}


def test_versions_hold_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENTS", 3)
    store = Store(spark, f"file://{tmp_path}/a")
    texts = {"a.md": "elm [[b]]", "b.md": "oak", "d/c.md": "---\ntags: [tall]\n---\nash [[a]] [[later]]"}
    refresh(store, notes(spark, texts), SETTINGS)
    whole = contents(store)
    steps = [{"b.md": "oak and fir"}, {"later.md": "yew"}, {"a.md": None, "e.md": "elm again [[b]]"}, {"a.md": "elm is back"}]
    bases = []
    for step in steps:
        texts = {p: t for p, t in (texts | step).items() if t is not None}
        refresh(store, notes(spark, texts), SETTINGS)
        fresh = Store(spark, f"file://{tmp_path}/fresh-{len(bases)}")
        refresh(fresh, notes(spark, texts), SETTINGS)
        assert contents(store) == contents(fresh)
        bases.append(store.head()["base"])
    assert bases == [1, 1, 4, 4] and store.version() == 5
    # a link whose note came later is found, and only its source's rows are written again
    assert "later.md" in str(store.table("links").collect()) and whole != contents(store)
    assert store.versions() == [4, 5] and not (tmp_path / "a/notes/v=1").exists()  # what no kept version needs is gone


def test_a_version_without_its_commit_is_not_there(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/a")
    refresh(store, notes(spark, {"a.md": "elm"}), SETTINGS)
    before = contents(store)
    (tmp_path / "a/commits/half.new").write_text("{")
    (tmp_path / "a/notes/v=2").mkdir()
    assert store.version() == 1 and contents(store) == before
    refresh(store, notes(spark, {"a.md": "elm", "b.md": "oak"}), SETTINGS)  # over what a crash left
    assert store.version() == 2 and store.table("notes").count() == 2
    late = Store(spark, store.path)
    late.version = lambda: 1  # a writer that began earlier
    with pytest.raises(RuntimeError, match="another writer"):
        late.commit({})
    assert store.version() == 2


def test_a_refresh_leaves_the_callers_cache(spark, tmp_path):
    held = spark.range(5).persist()
    held.count()
    refresh(Store(spark, f"file://{tmp_path}/a"), notes(spark, {"a.md": "elm"}), SETTINGS)
    assert held.storageLevel.useMemory
    held.unpersist()


def engine_of(spark, root, embedder=None):
    return Engine(spark, str(root), Config(str(root)).validated(), embedder or HashingEmbedder())


@pytest.fixture
def root(tmp_path):
    for name, text in {"a.md": "---\ntags: [tall]\n---\nelm tree", "d/b.md": "elm hedge", "d/c.md": "---\ntags: [tall]\n---\nelm row"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_strict_filters_and_models(spark, root):
    engine = engine_of(spark, root)
    engine.refresh()
    paths = lambda **k: {r.path for r in engine.search("elm", mode="fts", **k).results.collect()}
    assert paths(folders=["d/"], tags=["tall"]) == {"a.md", "d/b.md", "d/c.md"}
    assert paths(folders=["d/"], strict=True) == {"d/b.md", "d/c.md"} and paths(tags=["tall"], strict=True) == {"a.md", "d/c.md"}
    assert paths(folders=["d/"], tags=["tall"], strict=True) == {"d/c.md"}
    other = engine_of(spark, root, HashingEmbedder(16))
    with pytest.warns(UserWarning, match="hashed words, 64"):
        assert other.search("elm", mode="semantic").results.count() == 0
    assert other.refresh().indexed == 3 and other.search("elm", mode="semantic").results.count() == 3


def test_old_files_are_taken_over(spark, root):
    from hashlib import sha256

    texts = {p: (root / p).read_text() for p in ("a.md", "d/b.md", "d/c.md")}
    meta = {"title": "x", "tags": "", "heading": "", "start_line": 1, "end_line": 1, "text": "t"}
    folder = root / settings.DATA_DIR
    folder.mkdir()
    vector = HashingEmbedder().embed(["elm"])[0]
    (folder / "vectors.json").write_text(json.dumps({"entries": [{"vector": vector, "metadata": meta | {"path": p}} for p in texts]}))
    (folder / "hashes.json").write_text(json.dumps({p: sha256(t.encode()).hexdigest() for p, t in texts.items()}))
    engine = engine_of(spark, root)
    assert engine.store.version() == 1 and not engine.store.has_documents()
    stats = engine.refresh()
    assert (stats.indexed, stats.skipped, stats.total_chunks) == (0, 3, 0)  # no note is embedded again
    assert engine.store.has_documents() and engine.search("elm", mode="fts").results.count() == 3
    assert engine.store.table("vectors").count() == 3


def test_server_speaks_json_rpc(spark, root):
    engine = engine_of(spark, root)
    engine.refresh()
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    call = lambda i, **arguments: ask(i, "tools/call", name="notes", arguments=arguments)
    lines = [
        ask(1, "initialize", protocolVersion="2024-11-05"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"),
        call(3, command="search", query="hedge", mode="fts", limit=5), call(4, command="get", path="../x"), "not json", ask(5, "fly"), ask(6, "tools/call", name="other"), "", ask(7, "ping"), call(8, command="list", path="d"),
    ]
    out = io.StringIO()
    serve(engine, io.StringIO("\n".join(lines)), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["result"]["serverInfo"]["name"] == "quernel" and got[2]["result"]["tools"][0]["name"] == "notes"
    assert json.loads(got[3]["result"]["content"][0]["text"])[0]["path"] == "d/b.md" and not got[3]["result"]["isError"]
    assert got[4]["result"]["isError"] and got[None]["error"]["code"] == -32700 and got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32602
    assert got[7]["result"] == {} and "d/c.md" in got[8]["result"]["content"][0]["text"] and len(got) == 9


def test_watch_status_and_stop(tmp_path):
    config = Config(str(tmp_path)).validated()
    assert watching.running(config) is None and not watching.stop(config)
    file = tmp_path / settings.DATA_DIR / "watch.pid"
    file.parent.mkdir()
    child = subprocess.Popen([sys.executable, "-c", "import time; time.sleep(60)"])
    file.write_text(str(child.pid))
    assert watching.running(config) == child.pid and watching.stop(config)
    child.wait(20)
    assert watching.running(config) is None and not file.exists()
    file.write_text("nonsense")
    assert watching.running(config) is None
    file.write_text(str(os.getpid()))
    with pytest.raises(RuntimeError, match="already"):
        watching.run(type("E", (), {"config": config})())


def test_global_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    for name in ("EMBEDDING_ENDPOINT", "EMBEDDING_MODEL", "EMBEDDING_PROVIDER"):
        monkeypatch.delenv(name, raising=False)
    assert settings.registered_default() is None
    own = tmp_path / "quernel"
    own.mkdir()
    (own / "config.toml").write_text("[search]\ndefault_limit = 3\n")
    (own / "state.json").write_text('{"default": "/somewhere"}')
    root = tmp_path / "notes"
    root.mkdir()
    got = settings.load(str(root), settings.global_file(), lambda: "http://localhost:11435")
    assert got.search.default_limit == 3 and got.embedding.endpoint == "http://localhost:11435"
    assert settings.load(str(root), settings.global_file(), lambda: None).embedding.endpoint == "http://localhost:11434"
    assert settings.resolve_root(None, str(root), settings.global_file(), settings.registered_default()) == "/somewhere"
    (root / ".obsidian").mkdir()
    assert settings.resolve_root(None, str(root), settings.global_file(), settings.registered_default()) == str(root)
