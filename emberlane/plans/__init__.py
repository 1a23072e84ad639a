"""All named queries of the library."""

from __future__ import annotations


def all_queries() -> dict:
    from emberlane.plans import catalog, curate, detect, more, scalars, tools  # noqa: F401  (they add to the catalog)

    return dict(catalog.QUERIES)


def all_oracles() -> dict:
    from emberlane.plans import catalog, curate, detect, more, scalars, tools  # noqa: F401  (they add to the catalog)

    return dict(catalog.ORACLES)
