"""Turns from growing logs: an assembler's state for each stream is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.folds import frame, records
from ..operators.turns import STREAM, TURN_COLUMNS, TURN_SCHEMA, Assembler
from ..operators.turns import dump_state as _dump
from ..operators.turns import load_state as _load

STATE_SCHEMA = "state string"


def assemble_stream(events: DataFrame) -> DataFrame:
    """Turns as they close, in append mode. A stream's open turn stays in its state; within a micro-batch events are applied in line order. An event that can't be applied gives a row with its error and is skipped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        a = Assembler(_load(group.get[0]) if group.exists else None)
        rows: list[dict] = []
        for e in records(pd.concat(list(batches)).sort_values(["line", "ord"], kind="stable")):
            try:
                rows += a.apply(e)
                if a.state["open"] and a.state["open"]["done"]:
                    rows += a.close()
            except ValueError as error:
                rows.append({"error": str(error)})
        group.update((_dump(a.state),))
        yield frame([{**r, **dict(zip(STREAM, key, strict=True))} for r in rows], TURN_COLUMNS, ("ts",))

    return events.groupBy(*STREAM).applyInPandasWithState(step, TURN_SCHEMA, STATE_SCHEMA, "append", "NoTimeout")
