"""Registered queries: each is an operator run over whole driver tables, with the
SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxmill.adapters import Tables, with_views

_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register the function under its name; ``sql`` may use the adapter views."""

    def keep(run: Callable[[Tables], DataFrame]):
        _QUERIES[run.__name__] = (run, sql)
        return run

    return keep


def _load() -> None:
    from boxmill.registry import (  # noqa: F401
        camera,
        extract,
        files,
        labels,
        merge,
        names,
        partition,
        reconcile,
        yolo,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(run):
        return lambda spark, folder: run(Tables(spark, folder))

    return {name: bind(run) for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, (_, sql) in _QUERIES.items() if sql is not None}
