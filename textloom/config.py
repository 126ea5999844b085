"""Frozen settings; operators take values, there is no mutable server."""

from __future__ import annotations

import re
import json
from dataclasses import dataclass, field, fields, replace
from typing import Literal

#: "intended" follows the documented behaviour, "compat" keeps known quirks of the surveyed system.
Mode = Literal["intended", "compat"]


@dataclass(frozen=True)
class Settings:
    split_length: int = 100
    long_sentence_chars: int = 300
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    top_k: int = 10
    top_k_expanded: int = 15
    max_expansions: int = 5
    expansions_per_source: int = 2
    similarity_percent: float = 70.0
    max_degree: int = 75
    knn_graph_k: int = 500
    knn_classify_k: int = 50
    nearest_k: int = 5
    tfidf_cutoff: float = 0.6
    neighbour_cutoff: int = 375
    idf_default: float = 0.5
    mode: Mode = "intended"
    field_weights: dict[str, float] = field(default_factory=lambda: {"content": 1.0, "doc_title": 1.0, "bm25": 1.0})

    def with_values(self, **values) -> Settings:
        return replace(self, **values)


def load_settings(text: str) -> Settings:
    """Settings from JSON with // and /* */ comments and trailing commas; groups are flattened, unknown keys ignored."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    known = {f.name for f in fields(Settings)}
    flat: dict = {}

    def walk(values: dict) -> None:
        for k, v in values.items():
            if k in known:
                flat[k] = v
            elif isinstance(v, dict):
                walk(v)

    walk(json.loads(plain))
    return Settings(**flat)


def is_off(url: str | None) -> bool:
    """Whether a service address means "not used"."""
    return url is None or url.strip().lower() in ("no", "none", "")


def enabled_fields(weights: dict[str, float]) -> list[str]:
    """Fields that get a dense pipeline: weight above 0 and not a lexical one."""
    return [f for f, w in weights.items() if w > 0 and not f.startswith("bm25")]


def expands_documents(weights: dict[str, float]) -> bool:
    """Document expansion runs only if both of its fields count."""
    return weights.get("filtered_NER_labels_domains", 0) > 0 and weights.get("neighbours", 0) > 0
