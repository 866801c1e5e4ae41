"""Defaults that are part of the operators' meaning."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ranking:
    k1: float = 1.5
    b: float = 0.75
    chunk_words: int = 180
    top_m: int = 5
    keywords: int = 20
    alpha: float = 0.5
    novelty_weight: float = 0.2
    damping: float = 0.85


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    keyword_boost: float = 1.05
    doc_boost: float = 2.0
    lexical_weight: float = 0.3
    top_k: int = 8
    score_floor: float = 0.5


@dataclass(frozen=True)
class Grounding:
    verbatim_run: int = 8
    claim_window: int = 400
    min_overlap: float = 0.5
    similarity: float = 0.6


@dataclass(frozen=True)
class GraphFacts:
    hub_doc_freq: int = 20
    min_seed_doc_freq: int = 2
    hop_decay: float = 0.5
    max_facts: int = 25
    max_ngram: int = 6


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 180
    overlap: int = 0
    min_section_merge: int = 60
    max_table_words: int = 300


@dataclass(frozen=True)
class Clustering:
    threshold: float = 0.75
    mutual_k: int = 10
    keywords: int = 20
