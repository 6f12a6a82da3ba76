"""All parameters of the plans. Nothing is read from the environment on import."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    raw_dir: str = "data"
    top_k: int = 10
    chunk_chars: int = 1200
    chunk_overlap: int = 200
    retrieval_alpha: float = 0.75
    max_chunks_per_source: int = 2
    retrieval_candidate_pool: int = 60
    enable_mode_routing: bool = True
    enable_mode_coverage: bool = False
    enable_clause_coverage: bool = False
    enable_query_expansion: bool = False
    min_chunks_per_mode: int = 1
    max_subqueries: int = 4
    min_chunks_per_clause: int = 2
    clause_min_overlap: float = 0.20
    max_expansion_queries: int = 3
    min_chunks_per_expansion: int = 1
    expansion_min_overlap: float = 0.15
    mode_match_bonus: float = 0.08
    mode_mismatch_penalty: float = 0.06
    acan_mismatch_penalty: float = 0.18
    embed_model: str = "offline-hash"
    embed_batch: int = 64
    embed_metadata: bool = False
    enable_rerank: bool = True
    rerank_alpha: float = 0.60
    enable_rewrite: bool = True
    rewrite_max_queries: int = 3
    enable_conflicts: bool = True
    enable_conflict_classifier: bool = False
    conflict_max_pairs: int = 12
    conflict_min_similarity: float = 0.45
    conflict_min_overlap: float = 0.12
    enable_critique: bool = True
    max_input_tokens: int = 4096
    max_output_tokens: int = 400
    reserved_tokens: int = 1000
    max_doc_tokens: int = 320
    max_packed_docs: int = 8
    max_history_turns: int = 3
    top_citations: int = 3
    max_citation_windows: int = 24
    required_claim_threshold: float = 0.70
    forbidden_claim_threshold: float = 0.80
    citation_support_threshold: float = 0.65
    min_guide_words: int = 120
    max_pages: int = 300

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> Settings:
        """The defaults, with every setting whose upper-cased name is set to something taken from there."""
        env = os.environ if env is None else env
        found = {}
        for field in fields(Settings):
            raw = env.get(field.name.upper(), "").strip()
            if raw:
                kind = type(field.default)
                found[field.name] = raw.lower() in {"1", "true", "yes", "on"} if kind is bool else kind(raw)
        return replace(Settings(), **found)
