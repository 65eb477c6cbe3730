"""Settings with defaults; cleared or invalid values fall back as each rule says."""

from __future__ import annotations

import re
from dataclasses import dataclass

PROVIDERS = ("llamacpp", "ollama", "openai")


def _number(value, default: int, positive: bool = True) -> int:
    try:
        n = int(float(str(value).strip() or 0))
    except ValueError:
        n = 0
    return default if positive and n <= 0 else n


def _decimal(text: str) -> float:
    """The number that a text begins with, else 0."""
    found = re.match(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", text)
    return float(found[0]) if found else 0.0


@dataclass(frozen=True)
class Config:
    embedding_server_url: str = "http://localhost:8080"
    generation_server_url: str = "http://localhost:8081"
    generation_max_tokens: int = 512
    generation_timeout: int = 300
    embedding_context_length: int = 6000
    rag_top_k: int = 5
    document_context_length: int = 800
    semantic_threshold: float = 0.30
    query_cache_ttl: int = 3600
    embedding_provider: str = "llamacpp"
    generation_provider: str = "llamacpp"
    openai_api_key: str = ""
    openai_embedding_model: str = "text-embedding-3-small"
    openai_generation_model: str = "gpt-4o-mini"
    ollama_server_url: str = "http://localhost:11434"
    ollama_embedding_model: str = "nomic-embed-text"
    ollama_generation_model: str = "llama3.2"
    system_prompt: str | None = None

    @classmethod
    def of(cls, raw: dict) -> Config:
        """From untyped values. Top-k, context length, threshold and lifetime are cast without a floor: cleared is 0."""
        base, out = cls(), {}
        for name, value in raw.items():
            default = getattr(base, name)
            text = "" if value is None else str(value).strip()
            if name in ("generation_max_tokens", "generation_timeout", "embedding_context_length"):
                out[name] = _number(text, default)
            elif name in ("rag_top_k", "document_context_length"):
                out[name] = _number(text, default, positive=False)
            elif name == "query_cache_ttl":
                out[name] = max(0, _number(text, default, positive=False))
            elif name == "semantic_threshold":
                out[name] = _decimal(text)
            elif name.endswith("_provider"):
                out[name] = text.lower() if text.lower() in PROVIDERS else "llamacpp"
            elif name == "system_prompt":
                out[name] = text or None
            else:
                out[name] = text or default
        return cls(**out)
