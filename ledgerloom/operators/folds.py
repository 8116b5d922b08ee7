"""Folds over groups in order, for rules that no window can express.

Rows are dealt by key and sorted within partitions; a task then walks through its
groups one after the other. It holds a batch of rows and what the group's own
stepper keeps, and small groups don't cost a call of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(pdf: pd.DataFrame) -> list[dict]:
    """Rows as dicts of plain values; missing ones are None, times are datetimes."""
    rows = pdf.astype(object).where(pdf.notna(), None)
    for c in pdf.columns[[str(t).startswith("datetime") for t in pdf.dtypes]]:
        rows[c] = pd.Series([None if v is None else v.to_pydatetime() for v in rows[c]], dtype=object, index=rows.index)
    return rows.to_dict("records")


def frame(rows: list[dict], columns: list[str], times: tuple[str, ...] = ()) -> pd.DataFrame:
    """Dicts as a table; columns without any value keep their type."""
    out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})
    return out.assign(**{c: pd.to_datetime(out[c]) for c in times})


class Stepper(Protocol):
    """What walks through one group."""

    def apply(self, row: dict) -> list[dict]:
        """The results that a row brings."""

    def end(self) -> list[dict]:
        """Those that the group's end brings."""


class Gathered:
    """A stepper for rules that need all rows of a group at once."""

    def __init__(self, key: tuple, step: Callable[[tuple, list[dict]], list[dict]]):
        self.key, self.step, self.rows = key, step, []

    def apply(self, row: dict) -> list[dict]:
        self.rows.append(row)
        return []

    def end(self) -> list[dict]:
        return self.step(self.key, self.rows)


def fold(rows: DataFrame, keys: list[str], order: list[str], stepper: Callable[[tuple], Stepper], schema: str, columns: list[str], times: tuple[str, ...] = ()) -> DataFrame:
    """What each group's own stepper makes of its rows, in order; results carry the group's key."""

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for pdf in it:
            out: list[dict] = []
            for r in records(pdf):
                own = tuple(r[k] for k in keys)
                if now is None or own != key:
                    out += [] if now is None else named(now.end(), key)
                    key, now = own, stepper(own)
                out += named(now.apply(r), key)
            yield frame(out, columns, times)
        if now is not None:
            yield frame(named(now.end(), key), columns, times)

    def named(found: list[dict], key: tuple) -> list[dict]:
        return [{**r, **dict(zip(keys, key, strict=True))} for r in found]

    # By a hash of the keys, not by the keys: Spark drops a shuffle by columns above a union whose parts it takes to be dealt by them already, also where adaptive execution dealt these parts differently.
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
