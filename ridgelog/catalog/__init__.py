"""Every operator as a named query over the given tables, with its SQL counterpart."""

from importlib import import_module

from ridgelog.catalog.registry import ORACLES, QUERIES, Query

_MODULES = ("filters", "aggregates", "traces", "errors", "metrics", "parsing", "storage", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"ridgelog.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
