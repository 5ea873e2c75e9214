"""Named queries: one Spark callable and, where SQL can say it, one check query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare
from tidemark.views import Views, with_views


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Views], DataFrame]
    check_sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its check SQL."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = Entry(name, fn, with_views(check) if check else None)
        return fn

    return register


def entries() -> dict[str, Entry]:
    import tidemark.catalog  # noqa: F401  (importing registers the queries)

    return dict(_ENTRIES)


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(Views(prepare(spark), sf_dir))

    run.__name__ = entry.name
    return run
