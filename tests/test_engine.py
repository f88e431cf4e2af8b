import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quernel import config as settings
from quernel.config import Config, Embedding, Index, Search
from quernel.functions.embed import HashingEmbedder, Health, HttpEmbedder, find_endpoint, health
from quernel.plans.engine import Engine
from quernel.sources import notes
from quernel.sources.render import to_text
from quernel.streaming.watch import watch


@pytest.fixture
def root(tmp_path):
    files = {
        "elm.md": "---\ntitle: Elm\ntags: [Tree]\n---\nThe elm grows by rivers.\nSee [[bark]].\n",
        "wiki/bark.md": "# Bark\nHow to tell rough bark.\n",
        "wiki/soup.md": "Barley and leeks.\n[[elm]]\n",
        ".obsidian/x.md": "hidden", "wiki/node_modules/y.md": "hidden", "_kept.md": "kept", "note.txt": "no",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    return tmp_path


def test_scan_list_get(spark, root):
    found = notes.scan_notes(spark, str(root))
    assert {r.path for r in found.collect()} == {"elm.md", "wiki/bark.md", "wiki/soup.md", "_kept.md", "bad.md"}
    assert found.where("path = 'bad.md'").first().content == ""
    assert notes.get_note(found, "wiki/soup.md").startswith("Barley")
    with pytest.raises(FileNotFoundError):
        notes.get_note(found, "../secret.md")
    assert {r.path for r in notes.list_folder(spark, str(root), "wiki").collect()} == {"wiki/bark.md", "wiki/soup.md"}
    assert notes.list_folder(spark, str(root), "..").count() == 0 and notes.list_folder(spark, str(root), "none").count() == 0
    assert notes.listing(notes.list_folder(spark, str(root), "wiki")).startswith("2 entries:\n      wiki/soup.md")
    assert notes.list_folder(spark, str(root), recursive=True).count() == 7


def test_refresh_search_and_tools(spark, root):
    engine = Engine(spark, str(root), Config(str(root)).validated(), HashingEmbedder())
    first = engine.refresh()
    assert (first.total_files, first.indexed, first.skipped, first.deleted) == (5, 5, 0, 0) and first.graph_edges == 2
    assert engine.refresh().skipped == 5
    (root / "elm.md").write_text("Elm changed. [[soup]]")
    os.remove(root / "_kept.md")
    (root / "new.md").write_text("About barley. [[elm]]")
    again = engine.refresh()
    assert (again.total_files, again.indexed, again.skipped, again.deleted) == (5, 2, 3, 1)

    def tables(e):
        return {n: sorted(map(str, e.store.table(n).drop("modified").collect())) for n in ("notes", "manifest", "vectors", "postings", "lengths", "links")}

    fresh = Engine(spark, str(root), engine.config, HashingEmbedder(), store=f"file://{root}/.vault-mcp/other")
    fresh.refresh()
    assert tables(engine) == tables(fresh)
    assert tables(engine) == (engine.refresh(force=True), tables(engine))[1]

    response = engine.search("barley elm", 3)
    assert response.results.first().match_type == "hybrid"
    assert set(json.loads(response.to_json())) == {"results", "linked_notes"}
    assert engine.search("barley", mode="fts").results.count() == 2
    assert engine.search("barley", mode="semantic", exclude=["wiki"], limit=2).results.where("path LIKE 'wiki%'").count() == 0
    assert engine.search("barley", since="2001-01-01").results.count() > 0 and engine.search("barley", since="2999-01-01").results.count() == 0
    lines = engine.context(engine.search("bark rough tell", 1).results, 1).collect()
    assert any(x.is_match for x in lines)
    assert json.loads(engine.call("search", query="barley", mode="fts"))[0]["match_type"] == "fts"
    assert "empty" in engine.call("search", query=" ") and "Unknown mode" in engine.call("search", query="x", mode="y") and "Unknown command" in engine.call("fly")
    assert engine.call("get", path="new.md").startswith("About") and "graph_nodes" in engine.call("status")
    text = to_text(response.results.collect(), response.linked_notes.collect())
    assert text.startswith("1. [hybrid]") and to_text([]) == "  No results found."

    seen = []
    query = watch(engine, str(root.parent / "checkpoint"), "1 second", seen.append)
    (root / "later.md").write_text("Later.")
    for _ in range(60):
        query.awaitTermination(1)
        if seen:
            break
    query.stop()
    assert seen and seen[0].indexed == 1


def nowhere():
    """An embedder whose endpoint isn't there."""
    return HttpEmbedder(Config(embedding=Embedding(endpoint="http://127.0.0.1:9")).validated().embedding)


def test_without_an_embedder_full_text_is_left(spark, root):
    engine = Engine(spark, str(root), Config(str(root)).validated(), HashingEmbedder())
    engine.refresh()
    engine.embedder = nowhere()
    assert {r.match_type for r in engine.search("barley").results.collect()} == {"fts"}
    assert engine.search("barley", mode="semantic").results.count() == 0
    with pytest.raises(Exception, match="refused"):
        engine.refresh(force=True)
    assert engine.store.version() == 1  # the old snapshot stays


def test_other_dimensions_force_a_rebuild(spark, root):
    engine = Engine(spark, str(root), Config(str(root)).validated(), HashingEmbedder())
    engine.refresh()
    engine.embedder = HashingEmbedder(16)
    assert engine.refresh().indexed == 5


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        n = len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"])
        broken = self.path.startswith("/broken")
        self.send_response(500 if broken else 200)
        self.end_headers()
        self.wfile.write(b"no" if broken else json.dumps({"data": [{"embedding": [0.1, 0.2]}] * n}).encode())

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'{"models": [{"name": "bge-m3:latest"}]}')

    def log_message(self, *_):
        pass


def test_http_embedder():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    good = Config(embedding=Embedding(endpoint=base)).validated().embedding
    assert len(HttpEmbedder(good).embed(["x"] * 70)) == 70
    assert health(good)[0] is Health.OK
    assert health(Config(embedding=Embedding(endpoint=base, model="other")).validated().embedding)[0] is Health.MODEL_MISSING
    with pytest.raises(RuntimeError, match="500"):
        HttpEmbedder(Config(embedding=Embedding(endpoint=base + "/broken")).validated().embedding).embed(["x"])
    server.shutdown()
    server.server_close()
    assert health(good)[0] is Health.UNREACHABLE and find_endpoint("http://127.0.0.1") is None


def test_settings(tmp_path, monkeypatch):
    merged = settings.merged({"search": {"vector_weight": 0.8}, "embedding": {"model": "x"}}, {"search": {"fts_weight": 0.4}})
    assert merged == {"search": {"vector_weight": 0.8, "fts_weight": 0.4}, "embedding": {"model": "x"}}
    with pytest.warns(UserWarning):
        fixed = Config(embedding=Embedding(model=" "), index=Index(max_chunk_tokens=0), search=Search(-1.0, 0.3, 0)).validated()
    assert (fixed.index.max_chunk_tokens, fixed.search.default_limit, fixed.search.vector_weight, fixed.embedding.model) == (400, 10, 0.0, "bge-m3")
    folder = tmp_path / settings.DATA_DIR
    folder.mkdir()
    (folder / "config.toml").write_text("[index]\nmax_chunk_tokens = 200\n[embedding]\nprovider = 'openai'\napi_key = '$KEY'\n")
    monkeypatch.setenv("KEY", "secret")
    monkeypatch.setenv("EMBEDDING_MODEL", "m")
    monkeypatch.setenv("EMBEDDING_PROVIDER", "custom")
    got = settings.load(str(tmp_path))
    assert (got.index.max_chunk_tokens, got.embedding.provider, got.embedding.model, got.embedding.authorization()) == (200, "openai", "m", "Bearer secret")
    monkeypatch.delenv("KEY")
    with pytest.raises(ValueError, match="key"):
        got.embedding.authorization()
    (tmp_path / "deep").mkdir()
    assert settings.resolve_root(None, str(tmp_path / "deep")) == str(tmp_path)
    assert settings.resolve_root("flag", "/") == "flag" and settings.resolve_root(None, "/", registered="r") == "r"
    with pytest.raises(FileNotFoundError):
        settings.resolve_root(None, "/")
