"""Settings of the engine, with overrides from the environment and from a .env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """All of them can be overridden by LOREKEEP_<NAME>; unknown names are ignored. tokens: "ascii" for runs of ASCII letters
    and digits, "any" for words of all scripts and single Chinese and Japanese characters, "words" for words of all scripts and
    Chinese ones by a learned lexicon (Engine.fit_segmenter)."""

    index_dir: str = "storage/index"
    pdf_dir: str = "storage/papers/pdf"
    text_dir: str = "storage/papers/txt"
    database: str = "lorekeep"
    embedding_dim: int = 64
    chunk_size: int = 800
    chunk_overlap: int = 150
    retrieval_k: int = 5
    bm25_weight: float = 0.3
    vector_weight: float = 0.7
    distance_cutoff: float = 1.5
    tokens: str = "ascii"
    history_pairs: int = 5
    search_page: int = 100
    search_delay_s: float = 3.0
    search_retries: int = 3
    api_base: str = "http://export.arxiv.org/api/query"

    @classmethod
    def load(cls, env_file: str | None = ".env", env: Mapping[str, str] | None = None) -> Settings:
        values: dict[str, str] = {}
        if env_file and Path(env_file).exists():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, sep, value = line.partition("=")
                if sep and not line.lstrip().startswith("#"):
                    values[name.strip().lower()] = value.strip().strip("'\"")
        values |= {k.lower().removeprefix("lorekeep_"): v for k, v in (os.environ if env is None else env).items() if k.upper().startswith("LOREKEEP_")}
        given = {f.name: type(f.default)(values[f.name]) for f in fields(cls) if f.name in values}
        return replace(cls(), **given)
