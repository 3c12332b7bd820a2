"""Query catalog: key -> (Spark query, DuckDB oracle SQL or None).

Every query reads the given tables (or data Spark derives from them) in
full.  ``sql`` is None only for model steps with no SQL form; those are
covered by invariant tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def _load_all():
    # import for side effects (registration)
    from . import q_flows, q_models, q_relational, q_text, q_tokens, q_topics, q_vectors  # noqa: F401


def queries() -> dict[str, Callable]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
