"""Registered queries: a Spark callable and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.catalog.inputs import Inputs
from fleetpulse.catalog.sql_views import VIEWS


@dataclass(frozen=True)
class Entry:
    run: Callable[[Inputs], DataFrame]
    sql: str | None
    floats: tuple[str, ...]
    digits: int


REGISTRY: dict[str, Entry] = {}


def query(
    name: str, sql: str | None = None, floats: Sequence[str] = (), digits: int = 6
) -> Callable[[Callable[[Inputs], DataFrame]], Callable[[Inputs], DataFrame]]:
    """Register a query. ``floats`` are compared after rounding to ``digits`` decimals."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, sql, tuple(floats), digits)
        return fn

    return register


def _nudge(digits: int) -> float:
    # sums run in different orders in the two engines; the nudge keeps exact decimal ties
    # such as x.xxxxxx5 from rounding to different sides
    return 1.3 * 10.0 ** -(digits + 3)


def run_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark result, with compared floats rounded."""
    e = REGISTRY[name]
    df = e.run(Inputs(spark, sf_dir))
    return df.withColumns({c: F.round(F.col(c) + _nudge(e.digits), e.digits) for c in e.floats})


def _with_views(body: str) -> str:
    """Prefix the view definitions the text mentions, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH {views}\n{body}"


def oracle(name: str) -> str | None:
    """The SQL counterpart, or None."""
    e = REGISTRY[name]
    if e.sql is None:
        return None
    body = f"SELECT * FROM ({e.sql}) AS result"
    if e.floats:
        picks = ", ".join(
            f'round(CAST("{c}" AS DOUBLE) + {_nudge(e.digits):.16f}::DOUBLE, {e.digits}) AS "{c}"' for c in e.floats
        )
        body = f"SELECT * REPLACE ({picks}) FROM ({e.sql}) AS result"
    return _with_views(body)
