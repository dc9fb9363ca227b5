"""Typed settings, read from the environment with safe defaults.

Values become literals inside column expressions; nothing here touches data.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from deskloom import lexicon as lx


def env_value(name: str, default):
    """Environment value cast to the default's type; the default when unset or malformed."""
    raw = os.environ.get(name)
    if raw is None or raw.strip() == "":
        return default
    raw = raw.strip()
    if isinstance(default, bool):
        return raw.lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(raw)
    except ValueError:
        return default


def _env(name: str, default):
    return field(default_factory=lambda: env_value(name, default))


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = _env("RETRIEVAL_TOP_K", 5)
    min_score: float = _env("RETRIEVAL_MIN_SCORE", 0.18)
    chunk_chars: int = _env("RETRIEVAL_CHUNK_CHARS", 900)
    chunk_overlap: int = _env("RETRIEVAL_CHUNK_OVERLAP", 150)
    dense_weight: float = _env("RETRIEVAL_DENSE_WEIGHT", 0.65)
    saturation: float = _env("RETRIEVAL_LEXICAL_SATURATION", 16.0)
    k1: float = 1.5
    b: float = 0.75
    per_document: int = 2
    # Length of a query's dense list in hybrid search, in ``top_k``; a matter of cost only.
    dense_lists: int = 4

    @property
    def dense_depth(self) -> int:
        return self.top_k * self.dense_lists


@dataclass(frozen=True)
class RoutingSettings:
    answerable_threshold: float = _env("ROUTE_ANSWERABLE_THRESHOLD", 0.58)
    min_confidence: float = _env("ROUTE_MIN_CLASS_CONF", 0.55)
    min_grounding: float = _env("ROUTE_MIN_GROUNDING", 0.60)
    never_automate: tuple[str, ...] = lx.NEVER_AUTOMATE
    high_risk_intents: tuple[str, ...] = lx.HIGH_RISK_INTENTS
    high_risk_urgency: tuple[str, ...] = lx.HIGH_RISK_URGENCY
    automation_enabled: bool = True


@dataclass(frozen=True)
class GuardrailSettings:
    block_on_pii: bool = _env("GUARD_BLOCK_PII", True)
    block_on_unsupported: bool = _env("GUARD_BLOCK_UNSUPPORTED", True)
    block_on_commitment: bool = _env("GUARD_BLOCK_COMMITMENT", True)
    support_dense: float = _env("GUARD_SENTENCE_SUPPORT", 0.38)
    support_lexical: float = 0.30
    min_supported_ratio: float = _env("GUARD_MIN_SUPPORTED_RATIO", 0.70)


@dataclass(frozen=True)
class ProviderSettings:
    model: str = _env("LLM_MODEL", "unset")
    temperature: float = _env("LLM_TEMPERATURE", 0.0)
    max_tokens: int = _env("LLM_MAX_TOKENS", 900)
    max_retries: int = _env("LLM_MAX_RETRIES", 4)
    max_retry_after: float = _env("LLM_MAX_RETRY_AFTER", 30.0)
    requests_per_minute: int = _env("LLM_RPM", 20)
    breaker_threshold: int = _env("LLM_CIRCUIT_THRESHOLD", 5)
    breaker_cooldown: float = _env("LLM_CIRCUIT_COOLDOWN", 60.0)


@dataclass(frozen=True)
class Settings:
    search: SearchSettings = field(default_factory=SearchSettings)
    routing: RoutingSettings = field(default_factory=RoutingSettings)
    guardrails: GuardrailSettings = field(default_factory=GuardrailSettings)
    provider: ProviderSettings = field(default_factory=ProviderSettings)
    # Product slug of the deployment: appears in the private-data allow-list
    # (support@<brand>), one webhook cue and the exported metric names.
    brand: str = _env("SUPPORT_BRAND", "helpdesk")
    run_id: str = _env("RUN_ID", "adhoc")
