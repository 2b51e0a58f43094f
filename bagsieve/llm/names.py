"""Names for columns that operators add on the way."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``frame`` has it."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def other_columns_apart(*used: str, made: tuple[str, ...] = ()):
    """For an operator that returns the columns of its first table, in order, and perhaps more: columns other than those in ``used``
    (and the one that ``text`` names) have neutral names inside, so that no name, with dots or like one of the operator's own, matters.

    Columns in ``made``, which the operator makes, are dropped from the table first.
    """

    def around(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(docs: DataFrame, *args, **how) -> DataFrame:
            docs = docs.drop(*made)
            own = {*used, how.get("text", "text")}
            out = f(docs.toDF(*(c if c in own else f"_column_{k}" for k, c in enumerate(docs.columns))), *args, **how)
            return out.toDF(*docs.columns, *out.columns[len(docs.columns) :])

        return run

    return around
