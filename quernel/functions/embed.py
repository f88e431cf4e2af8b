"""Embedders: an HTTP endpoint, or hashed words for work without one."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Iterator
from enum import Enum
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Embedding
from ..plans.query_language import words_of
from ..schemas import VECTORS

TIMEOUT, HEALTH_TIMEOUT, PROBE_TIMEOUT = 120, 5, 0.8
#: Requests to one endpoint at a time, as tasks.
IN_FLIGHT = 4
# Ports of local servers that are looked for.
PORTS = (11434, 11435, 11436, 8080)


class Embedder(Protocol):
    batch_size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Words hashed to signed dimensions, unit length: the same everywhere, needs no network."""

    batch_size = 512

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.name = dimensions, f"hashed words, {dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in words_of(text):
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


class HttpEmbedder:
    """POST {endpoint}/v1/embeddings."""

    def __init__(self, settings: Embedding):
        self.settings, self.batch_size = settings, settings.batch_size
        self.name, self.in_flight = f"{settings.provider}, {settings.model}, {settings.dimensions}", IN_FLIGHT

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch_size):
            out += self._request(texts[at : at + self.batch_size])
        return out

    def _request(self, texts: list[str]) -> list[list[float]]:
        s = self.settings
        body = {"model": s.model, "input": texts} | ({"dimensions": s.dimensions} if s.dimensions else {})
        headers = {"Content-Type": "application/json"} | ({"Authorization": a} if (a := s.authorization()) else {})
        request = urllib.request.Request(f"{s.endpoint.rstrip('/')}/v1/embeddings", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
                rows = json.load(r)["data"]
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"embedding request failed: {e.code} {e.read().decode(errors='replace')[:200]}") from e
        if len(rows) != len(texts):
            raise RuntimeError(f"{len(texts)} texts gave {len(rows)} vectors")
        return [row["embedding"] for row in rows]


class Health(Enum):
    OK = "ok"
    UNREACHABLE = "unreachable"
    MODEL_MISSING = "model missing"


def health(settings: Embedding) -> tuple[Health, str]:
    """Whether a local server answers and has the model; other providers count as healthy."""
    if settings.provider != "ollama":
        return Health.OK, ""
    try:
        with urllib.request.urlopen(f"{settings.endpoint.rstrip('/')}/api/tags", timeout=HEALTH_TIMEOUT) as r:
            models = [m.get("name", "") for m in json.load(r).get("models", [])]
    except (OSError, ValueError) as e:
        return Health.UNREACHABLE, str(e)
    if any(settings.model in m for m in models):
        return Health.OK, ""
    return Health.MODEL_MISSING, f"{settings.model} isn't among {', '.join(models) or 'no models'}"


def find_endpoint(host: str = "http://localhost") -> str | None:
    """The first local port that answers."""
    for port in PORTS:
        try:
            with urllib.request.urlopen(f"{host}:{port}/api/tags", timeout=PROBE_TIMEOUT):
                return f"{host}:{port}"
        except (OSError, ValueError):
            continue
    return None


def name_of(embedder: Embedder) -> str:
    """What model makes the vectors; the class's name where an embedder doesn't say."""
    return getattr(embedder, "name", type(embedder).__name__)


def embed_chunks(chunks: DataFrame, embedder: Embedder, parallelism: int | None = None) -> DataFrame:
    """vectors of chunks; each request has a batch of them, across notes.

    An embedder with ``in_flight`` gets so many tasks; others, that make their
    vectors themselves, as many as the chunks have.
    """
    parallelism = parallelism or getattr(embedder, "in_flight", None)
    names = [x.split()[0] for x in VECTORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, embedder.batch_size):
                part = batch.slice(at, embedder.batch_size)
                inputs = [t if h is None else f"{h}\n\n{t}" for h, t in zip(part.column("heading").to_pylist(), part.column("text").to_pylist())]
                found = embedder.embed(inputs)
                if len(found) != len(inputs):
                    raise RuntimeError("fewer vectors than chunks")
                heading = pa.array([h or "" for h in part.column("heading").to_pylist()], pa.string())
                columns = [heading if n == "heading" else pa.array(found, pa.list_(pa.float32())) if n == "embedding" else part.column(n) for n in names]
                yield pa.record_batch(columns, names)

    return (chunks.repartition(parallelism) if parallelism else chunks).mapInArrow(run, VECTORS)
