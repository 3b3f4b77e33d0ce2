"""Parameters of the engine, all of them plain values."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    top_k: int = 8
    parent_top_k: int = 3
    score_threshold: float = 0.3
    multi_query_count: int = 3
    compression_ratio: float = 0.6
    rerank_top_n: int = 5
    rrf_k: int = 60
    child_size: int = 512
    child_overlap: int = 64
    parent_size: int = 2048
    parent_overlap: int = 128
    k1: float = 1.5
    b: float = 0.75
    term_boost: float = 1.5
    confidence_threshold: float = 0.55
    hallucination_threshold: float = 0.4

    @classmethod
    def load(cls, env: dict[str, str]) -> Params:
        """Parameters from variables named like the fields in capitals."""
        return cls(**{f.name: type(f.default)(env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})
