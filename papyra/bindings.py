"""Every query over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from papyra.plans import changes as _changes
from papyra.plans import desk as _desk
from papyra.plans import files as _files
from papyra.plans import layers as _layers
from papyra.plans import papers as _papers
from papyra.plans import pipelines as _pipelines
from papyra.plans import registry
from papyra.plans import relational as _relational
from papyra.plans import terms as _terms
from papyra.plans import texts as _texts

__all__ = ["oracle_sql", "queries"]
_ = (_changes, _desk, _files, _layers, _papers, _pipelines, _relational, _terms, _texts)  # importing a module registers its queries


def queries() -> dict[str, registry.Query]:
    """Query functions by name."""
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(registry.SQL)
