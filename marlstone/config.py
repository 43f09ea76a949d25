"""Engine configuration, from the environment or a .env file."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from marlstone.functions import rules as R


def collection_name(name: str) -> str:
    plain = re.sub(r"[^A-Za-z0-9_]", "_", name)
    if plain[:1].isdigit() and plain[:1].isascii():
        plain = "c_" + plain
    return (plain or "code_context")[:255]


def store_alias(value: str) -> str:
    return "zilliz" if value.strip().lower() in ("zilliz", "milvus") else "local-jsonl"


def read_env(path: str | Path) -> dict[str, str]:
    """KEY=value lines of a .env file; nothing if there is no file."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").split("\n"):
            m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
            if m:
                out[m[1]] = m[2][1:-1] if m[2][:1] in "\"'" and m[2][-1:] == m[2][:1] and len(m[2]) > 1 else m[2]
    return out


@dataclass(frozen=True)
class EngineConfig:
    provider: str = "ollama"
    dimension: int = 768
    urls: Mapping[str, str] = field(default_factory=lambda: {"ollama": "http://localhost:11434", "openai": "https://api.openai.com/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta"})
    models: Mapping[str, str] = field(default_factory=lambda: {"ollama": "nomic-embed-text:latest", "openai": "text-embedding-ada-002", "gemini": "embedding-001"})
    keys: Mapping[str, str] = field(default_factory=dict)
    vector_store: str = "local-jsonl"
    vector_store_path: str = ""
    remote_uri: str = ""
    remote_token: str = ""
    collection: str = "code_context"
    extensions: tuple[str, ...] = R.SCAN_EXTENSIONS
    chunk_size: int = 800
    max_chunk: int = R.MAX_CHUNK
    auto_index: bool = True
    project_path: str = ""
    index_state_path: str = ""
    search_timeout: int = 30
    index_timeout: int = 300
    stats_enabled: bool = False
    stats_path: str = "token-stats.json"
    chars_per_token: float = 4.0
    baselines: Mapping[str, int] = field(default_factory=lambda: dict(R.BASELINES))
    retention_days: int = R.RETENTION_DAYS

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        e = {**read_env(".env"), **os.environ} if env is None else env

        def number(key: str, default, kind=int):
            try:
                return kind(e[key]) if e.get(key) else default
            except ValueError:
                return default

        flag = lambda key, default: e[key].strip().lower() in ("1", "t", "true", "yes", "on") if e.get(key) else default
        base = cls()
        provider = e.get("EMBEDDING_PROVIDER") or "ollama"
        collection = collection_name(e.get("COLLECTION_NAME") or "code_context")
        names = {"ollama": ("OLLAMA_URL", "OLLAMA_EMBED_MODEL"), "openai": ("OPENAI_BASE_URL", "OPENAI_EMBED_MODEL"), "gemini": ("GEMINI_BASE_URL", "GEMINI_EMBED_MODEL")}
        extensions = tuple(x.strip() for x in e.get("SCAN_EXTENSIONS", "").split(",") if x.strip()) or R.SCAN_EXTENSIONS
        tools = {"code_search": "CODE_SEARCH", "file_context": "FILE_CONTEXT", "symbol_search": "SYMBOL_SEARCH", "impact_analysis": "IMPACT_ANALYSIS"}
        return cls(
            provider=provider if provider in names else "ollama",
            dimension=number("EMBEDDING_DIM", 768),
            urls={k: e.get(u) or base.urls[k] for k, (u, _) in names.items()},
            models={k: e.get(m) or base.models[k] for k, (_, m) in names.items()},
            keys={"openai": e.get("OPENAI_API_KEY", ""), "gemini": e.get("GEMINI_API_KEY", "")},
            vector_store=store_alias(e.get("VECTOR_STORE", "local")),
            vector_store_path=e.get("VECTOR_STORE_PATH") or f"{collection}.jsonl",
            remote_uri=e.get("ZILLIZ_URI", ""),
            remote_token=e.get("ZILLIZ_TOKEN", ""),
            collection=collection,
            extensions=extensions,
            chunk_size=number("CHUNK_SIZE", 800),
            max_chunk=number("MAX_CHUNK_SIZE", R.MAX_CHUNK),
            auto_index=flag("AUTO_INDEX", True),
            project_path=e.get("PROJECT_PATH", ""),
            index_state_path=e.get("INDEX_STATE_PATH", ""),
            search_timeout=number("SEARCH_TIMEOUT_SECONDS", 30),
            index_timeout=number("INDEX_TIMEOUT_SECONDS", 300),
            stats_enabled=flag("TOKEN_STATS_ENABLED", False),
            stats_path=e.get("TOKEN_STATS_PATH") or "token-stats.json",
            chars_per_token=number("TOKEN_STATS_CHARS_PER_TOKEN", 4.0, float),
            baselines={t: number(f"TOKEN_STATS_{n}_BASELINE", R.BASELINES[t]) for t, n in tools.items()},
            retention_days=number("TOKEN_STATS_RETENTION_DAYS", R.RETENTION_DAYS),
        )

    def dimension_warning(self) -> tuple[int, str]:
        """(expected dimension, warning), or (0, '') if nothing is wrong or the model is unknown."""
        model = self.models[self.provider]
        exact = self.provider == "openai"
        for name, d in R.MODEL_DIMENSIONS.items():
            if (name == model if exact else name in model) and d != self.dimension:
                return d, f"{model} gives {d} dimensions, EMBEDDING_DIM is {self.dimension}"
        return 0, ""
