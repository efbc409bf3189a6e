"""Every tunable number of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 0.01
    title_weight: int = 3


@dataclass(frozen=True)
class Retrieval:
    per_list: int = 50
    rrf_k: int = 60
    limit: int = 20
    report_limit: int = 8
    candidates: int = 12
    short_circuit_score: float = 10.0


@dataclass(frozen=True)
class Thresholds:
    duplicate: float = 0.35
    collision: float = 0.5
    collision_below_duplicate: float = 0.6
    verified: float = 70.0
    report_minimum: int = 50


@dataclass(frozen=True)
class Caps:
    per_caller_hour: int = 20
    per_caller_day: int = 60
    global_day: int = 300
    monthly_usd: float = 3.0


@dataclass(frozen=True)
class Live:
    ttl_seconds: int = 300
    timeout_seconds: int = 6
    page_size: int = 100
    pages: int = 3
    enriched: int = 40
    compact_after: int = 50
    judge_timeout_seconds: int = 45


@dataclass(frozen=True)
class Config:
    bm25: Bm25 = field(default_factory=Bm25)
    retrieval: Retrieval = field(default_factory=Retrieval)
    thresholds: Thresholds = field(default_factory=Thresholds)
    caps: Caps = field(default_factory=Caps)
    live: Live = field(default_factory=Live)


DEFAULT = Config()
