"""Training-data operators: thirteen corpus operators and their queries.

Nothing else in the library imports this package; ``queries()`` and
``oracle_sql()`` are merged by ``__spark_entry__.py`` when it is present.
"""

from __future__ import annotations


def _registry():
    """Import the query modules (here, so that tasks load only what they use)."""
    from . import (chat_format, decontaminate, html_extract, licenses, mixing, ngram_join, packing, periodic_runs, pii,  # noqa: F401
                   quality_gam, quality_rules, ranked_search, token_index)
    from .common import REGISTRY
    return REGISTRY


def queries():
    return {k: fn for k, (fn, _) in _registry().items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in _registry().items() if sql is not None}
