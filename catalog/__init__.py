"""Every operator as a query over the test tables, with its SQL oracle."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("sources", "cleaning", "joins", "features", "reports", "models")


def _load() -> None:
    for section in SECTIONS:
        import_module(f"catalog.{section}")


def all_queries():
    from catalog.base import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from catalog.base import ORACLES

    _load()
    return dict(ORACLES)
