"""Defaults of the engine."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    parent_size: int = 4000
    parent_overlap: int = 400
    child_size: int = 800
    child_overlap: int = 100
    top_k: int = 5
    relevant: float = 0.7
    context_tokens: int = 4000
    chars_per_token: int = 4
    history: int = 10
    summary_chars: int = 2000
    jobs_kept: int = 100
    feedback_window: int = 1000
    message_chars: int = 3900
    session_gap: str = "3 hours"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_constant: int = 60


DEFAULTS = Defaults()
