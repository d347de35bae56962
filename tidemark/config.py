"""Default parameters of the engine, as one frozen object. All are parameters of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # vectors and topics
    dimensions: int = 256
    query_weight: float = 0.7
    title_weight: float = 0.3
    topic_admission: float = 0.62
    topic_margin: float = 0.08
    runner_up_admission: float = 0.55
    softmax_factor: float = 10.0
    max_topics: int = 128
    label_chars: int = 72
    # retrieval
    semantic_admission: float = 0.45
    facet_bonus: float = 0.05
    lexical_coverage: float = 0.50
    facet_agreement: float = 0.0
    rrf_offset: int = 60
    channel_candidates: int = 64
    confirmed_candidates: int = 32
    temporal_fraction: float = 0.1
    recency_half_life: float = 14.0
    recency_share: float = 0.7
    session_cap: int = 4
    query_terms: int = 32
    # packets
    context_records: int = 6
    records_per_site: int = 2
    packet_margin: int = 64
    # activity
    window_seconds: int = 1800
    half_lives: tuple[float, ...] = (1.0, 7.0, 30.0)
    share_prior: float = 2.0
    burst_prior: float = 0.01
    min_visit_seconds: int = 5
    seconds_cap: int = 3600
    retention_days: int = 90
    future_seconds: int = 300
    # BM25
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 1e-6


DEFAULTS = Defaults()
