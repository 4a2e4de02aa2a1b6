"""Work on whole pages of boxes: pages are gathered once, and many of them are handled together as arrays.

A page is one physical sheet, so its boxes are few; a task holds ROWS boxes or one page, whichever is more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
ROWS = 1 << 16


def over_pages(boxes: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str,
               order: Sequence[str] = ("box_no",)) -> DataFrame:
    """``work(table, page)`` over tables of whole pages, sorted by page and ``order``; ``page`` numbers each row's page.

    One shuffle, by page. ``work`` gives a table with the columns of ``schema``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            page = _page_numbers(table)
            whole = int(np.searchsorted(page, page[-1]))  # the last page may go on
            if whole:
                yield from work(table.slice(0, whole), page[:whole]).to_batches()
                held = table.slice(whole).to_batches()
                rows = table.num_rows - whole
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, _page_numbers(table)).to_batches()

    # By a hash of the keys, as the planner drops a repartition its input already satisfies
    return boxes.repartition(F.xxhash64(*PAGE)).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


def _page_numbers(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for name in PAGE:
        codes = pc.fill_null(table.column(name).combine_chunks().dictionary_encode().indices, -1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def numbers(table: pa.Table, name: str, missing: float = np.nan) -> np.ndarray:
    return pc.fill_null(table.column(name).cast(pa.float64()), missing).to_numpy()


def sides(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(numbers(table, s) for s in ("x1", "y1", "x2", "y2"))


def beside(page: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places on one page whose heights overlap, each pair once.

    Sorted by their tops, a row is compared with the one, two, three ... rows after it while those start above its
    bottom, so the work grows with the overlaps. Rows without a height meet nothing.
    """
    solid = np.flatnonzero(bottom > top)
    order = solid[np.lexsort((top[solid], page[solid]))]
    p, t, b = page[order], top[order], bottom[order]
    at, lag, us, vs = np.arange(len(order)), 1, [], []
    while len(at):
        at = at[at + lag < len(order)]
        at = at[(p[at] == p[at + lag]) & (t[at + lag] < b[at])]
        us.append(order[at])
        vs.append(order[at + lag])
        lag += 1
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def shared_area(box: tuple[np.ndarray, ...], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = box
    wide = np.minimum(x2[u], x2[v]) - np.maximum(x1[u], x1[v])
    high = np.minimum(y2[u], y2[v]) - np.maximum(y1[u], y1[v])
    return np.maximum(wide, 0) * np.maximum(high, 0)


def undominated(count: int, worse: np.ndarray, better: np.ndarray) -> np.ndarray:
    """Which rows stay when, best first, every row is dropped that a row kept before dominates.

    Rows whose better rivals are all decided are decided together; the rounds are as many as the longest chain.
    """
    kept, open_ = np.ones(count, bool), np.zeros(count, bool)
    open_[worse] = True
    while len(worse):
        beaten = worse[~open_[better] & kept[better]]
        kept[beaten], open_[beaten] = False, False
        undecided = open_[worse] & (open_[better] | kept[better])
        worse, better = worse[undecided], better[undecided]
        waiting = np.zeros(count, bool)
        waiting[worse] = True
        open_ &= waiting
    return kept


def covered(of: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of each stretch ``left`` to ``right`` under the union of its spans; ``of`` names a span's stretch.

    Spans sorted by their starts add what reaches beyond all before them.
    """
    start, end = np.maximum(start, left[of]), np.minimum(end, right[of])
    some = np.flatnonzero(end > start)
    order = some[np.lexsort((start[some], of[some]))]
    of, start, end = of[order], start[order], end[order]
    reach, lag = end.copy(), 1
    while lag < len(of):  # running maximum inside each stretch, over 2, 4, 8 ... spans
        same = np.flatnonzero(of[lag:] == of[:-lag]) + lag
        if not len(same):
            break
        reach[same] = np.maximum(reach[same], reach[same - lag])
        lag *= 2
    before = np.full(len(of), -np.inf)
    same = np.flatnonzero(of[1:] == of[:-1]) + 1
    before[same] = reach[same - 1]
    added = np.maximum(0, end - np.maximum(start, before))
    total = np.bincount(of, added, len(left))
    width = right - left
    return np.divide(total, width, out=np.zeros(len(left)), where=width > 0)
