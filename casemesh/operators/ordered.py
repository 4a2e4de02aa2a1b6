"""Ordered scan: run a small stateful step over the rows of each key, one row in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable, step: Callable,
                 schema: str, at_end: Callable | None = None, together: bool = False) -> DataFrame:
    """Rows are shuffled by ``keys``, sorted inside the partitions and streamed through ``step``.

    ``start(row)`` gives a key's first state, ``step(state, row)`` gives ``(state, output rows)`` and
    ``at_end(row, state)`` gives the rows to add after a key's last row. No group is ever held whole; callers
    choose ``keys`` so that a key is bounded. ``together`` says that ``df`` is itself the result of an ordered scan
    by the same keys: its partitions hold whole keys already, so it is only sorted anew, not shuffled.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0].strip("`") for f in schema.split(",")]
        current, state, last = None, None, None
        for batch in batches:
            out: list = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if at_end and current is not None:
                        out.extend(at_end(last, state))
                    current, state = key, start(row)
                state, rows = step(state, row)
                out.extend(rows)
                last = row
            yield pd.DataFrame(out, columns=names)
        if at_end and current is not None:
            yield pd.DataFrame(list(at_end(last, state)), columns=names)

    # By a hash of the keys rather than by the keys: the planner drops a repartition its input already satisfies,
    # and adaptive execution may then change that input's partitioning without putting it back.
    placed = df if together else df.repartition(F.xxhash64(*keys))
    return placed.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
