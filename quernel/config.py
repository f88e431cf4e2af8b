"""Settings: defaults, TOML files, environment, validation."""

from __future__ import annotations

import json
import os
import tomllib
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

# providers' default endpoints, models and batch sizes.
PROVIDERS = {
    "ollama": ("http://localhost:11434", "bge-m3", 32),
    "openai": ("https://api.openai.com", "text-embedding-3-small", 512),
    "custom": ("http://localhost:8080", "custom-model", 32),
}
# Fixed value: where a note folder keeps its index and settings.
DATA_DIR = ".vault-mcp"


@dataclass(frozen=True)
class Embedding:
    provider: str = "ollama"
    endpoint: str = ""
    model: str = ""
    api_key: str | None = None
    dimensions: int | None = None

    @property
    def batch_size(self) -> int:
        return PROVIDERS[self.provider][2]

    def key(self) -> str | None:
        """The API key; ``$NAME`` reads the environment."""
        if self.api_key and self.api_key.startswith("$"):
            return os.environ.get(self.api_key[1:], "")
        return self.api_key

    def authorization(self) -> str | None:
        """The request's Authorization header; raises where a key is needed and missing."""
        if self.provider == "ollama":
            return "Bearer ollama"
        key = self.key()
        if key == "" or key is None and self.provider == "openai":
            raise ValueError(f"provider {self.provider} needs an API key")
        return None if key is None else f"Bearer {key}"


@dataclass(frozen=True)
class Index:
    data_dir: str = DATA_DIR
    max_chunk_tokens: int = 400


@dataclass(frozen=True)
class Search:
    vector_weight: float = 0.7
    fts_weight: float = 0.3
    default_limit: int = 10


@dataclass(frozen=True)
class Config:
    root: str = ""
    embedding: Embedding = field(default_factory=Embedding)
    index: Index = field(default_factory=Index)
    search: Search = field(default_factory=Search)

    def index_path(self) -> str:
        return os.path.join(self.root, self.index.data_dir, "spark")

    def validated(self) -> Config:
        """This configuration with values out of range set to defaults."""
        e, i, s = self.embedding, self.index, self.search
        endpoint, model, _ = PROVIDERS[e.provider]
        e = replace(e, endpoint=e.endpoint or endpoint, model=e.model if e.model.strip() else model)
        if i.max_chunk_tokens <= 0:
            i = replace(i, max_chunk_tokens=Index.max_chunk_tokens)
        if s.default_limit <= 0:
            s = replace(s, default_limit=Search.default_limit)
        s = replace(s, vector_weight=max(0.0, s.vector_weight), fts_weight=max(0.0, s.fts_weight))
        if (total := s.vector_weight + s.fts_weight) > 0 and abs(total - 1) > 0.01:
            warnings.warn(f"search weights add up to {total}, not 1", stacklevel=2)
        if not e.endpoint.startswith(("http://", "https://")):
            warnings.warn(f"endpoint {e.endpoint} isn't an http address", stacklevel=2)
        return replace(self, embedding=e, index=i, search=s)


def merged(outer: dict | None, inner: dict | None) -> dict | None:
    """Two files' contents: the inner one's embedding replaces the outer's, other sections merge field by field."""
    if not outer or not inner:
        return inner or outer
    out = {name: {**outer.get(name, {}), **inner.get(name, {})} for name in ("search", "index") if name in outer or name in inner}
    if section := inner.get("embedding") or outer.get("embedding"):
        out["embedding"] = section
    return out


def _file(path: Path) -> dict | None:
    try:
        return tomllib.loads(path.read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return None


def global_file() -> str:
    """Where a user's own settings are, for all folders."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "quernel", "config.toml")


def registered_default() -> str | None:
    """The note folder that state.json beside the global file names as default."""
    try:
        return json.loads((Path(global_file()).parent / "state.json").read_text()).get("default")
    except (OSError, ValueError, AttributeError):
        return None


def load(root: str, global_file: str | None = None, probe: Callable[[], str | None] | None = None) -> Config:
    """The settings of a note folder: environment over its file, over the global file, over defaults.

    probe: finds the endpoint of a local server, asked where nothing names one.
    """
    own = _file(Path(root) / DATA_DIR / "config.toml")
    found = merged(_file(Path(global_file)) if global_file else None, own)
    sections = found or {}
    known = lambda cls, values: {k: v for k, v in values.items() if k in cls.__dataclass_fields__}
    embedding = known(Embedding, sections.get("embedding", {}))
    env = {"endpoint": "EMBEDDING_ENDPOINT", "model": "EMBEDDING_MODEL"}
    if found is None:  # these are read only where no file speaks
        env |= {"provider": "EMBEDDING_PROVIDER", "api_key": "EMBEDDING_API_KEY", "dimensions": "EMBEDDING_DIMENSIONS"}
    for name, variable in env.items():
        if value := os.environ.get(variable):
            embedding[name] = int(value) if name == "dimensions" else value
    if embedding.get("provider", "ollama") not in PROVIDERS:
        embedding["provider"] = "custom"
    if probe and not embedding.get("endpoint") and embedding.get("provider", "ollama") == "ollama" and (at := probe()):
        embedding["endpoint"] = at
    return Config(
        root, Embedding(**embedding), Index(**known(Index, sections.get("index", {}))), Search(**known(Search, sections.get("search", {})))
    ).validated()


def resolve_root(flag: str | None, start: str, global_config: str | None = None, registered: str | None = None) -> str:
    """The note folder to use: the flag, the nearest folder with settings, the nearest notebook if there is a
    global file, that file's path, the registered default; else an error."""
    if flag:
        return flag
    here = [Path(start).resolve(), *Path(start).resolve().parents]
    for folder in here:
        if (folder / DATA_DIR / "config.toml").is_file():
            return str(folder)
    settings = _file(Path(global_config)) if global_config else None
    if settings is not None:
        for folder in here:
            if (folder / ".obsidian").is_dir():
                return str(folder)
        if path := settings.get("vault_path"):
            return str(path)
    if registered:
        return registered
    raise FileNotFoundError("no note folder found; name one or run from inside one")
