"""Typed settings, read once and passed on explicitly."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Settings:
    top_k: int = 12
    hybrid_enabled: bool = True
    chunk_size_tokens: int = 400
    chunk_overlap_tokens: int = 50
    ocr_confidence_threshold: float = 60.0
    ocr_min_chars: int = 50
    ocr_min_tokens: int = 10
    ocr_min_alpha_ratio: float = 0.4
    api_max_retries: int = 3
    api_backoff_base: float = 2.0
    api_timeout: int = 30
    rate_limit_rpm: int = 500
    model_chat: str = "offline"
    model_vision: str = "offline"
    model_embed: str = "offline"
    index_backend: str = "exact"
    data_dir: str = "data"
    doc_id_strategy: str = "hash"
    reupload_policy: str = "new_version"

    def __post_init__(self) -> None:
        if self.index_backend not in ("exact", "faiss"):
            raise ValueError(f"unknown index backend: {self.index_backend}")
        if self.reupload_policy not in ("new_version", "overwrite"):
            raise ValueError(f"unknown re-upload policy: {self.reupload_policy}")


def resolve(value: Any, environment: dict[str, str] | None = None) -> Any:
    """Values that are wholly ``${NAME}`` come from the environment, missing ones as empty text; containers are walked."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) for v in value]
    if isinstance(value, str) and (m := re.fullmatch(r"\$\{(\w+)\}", value)):
        return env.get(m.group(1), "")
    return value


def read_plain_yaml(text: str) -> dict[str, Any]:
    """One ``key: value`` a line: the flat part of YAML that settings need."""
    out: dict[str, Any] = {}
    for line in text.splitlines():
        m = re.match(r"^([\w.-]+)\s*:\s*(.*?)\s*(?:#.*)?$", line)
        if m and m.group(2) != "":
            raw = m.group(2).strip("\"'")
            out[m.group(1)] = {"true": True, "false": False, "null": None}.get(raw.lower(), int(raw) if re.fullmatch(r"-?\d+", raw) else float(raw) if re.fullmatch(r"-?\d*\.\d+", raw) else raw)
    return out


def load_settings(path: str, environment: dict[str, str] | None = None) -> Settings:
    """Settings from a file; unknown keys are ignored, missing ones keep their default."""
    with open(path, encoding="utf-8") as f:
        values = resolve(read_plain_yaml(f.read()), environment)
    known = {x.name for x in fields(Settings)}
    return Settings(**{k: v for k, v in values.items() if k in known and v is not None})
