"""Packing of token sequences into windows, planned by non-negative least squares over the length histogram."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from casemesh.llm.common import give_back, large_apart, own_name, slices, stored
from casemesh.llm.library_ids import encoder_of_worker

WINDOW = 2_048
END_ID = 1
#: Combinations that the least squares weighs at most, and its steps.
MOST_COMBINATIONS, STEPS = 20_000, 400


# --- pieces ---------------------------------------------------------------------------------------------------------

def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut at every ``window`` ids.

    Columns doc_id, start, length, ids_crc32, doc_tokens, then ``part`` and ``nth``: the task that made the piece and
    how many pieces of this length it made before, in the order of the scan; with ``with_ids`` also the ids.
    """
    hidden = own_name()
    source = docs.select("doc_id", docs["text"].cast("string").alias(hidden))
    fields = [source.schema["doc_id"], *[StructField(c, LongType()) for c in
                                         ("start", "length", "ids_crc32", "doc_tokens", "part", "nth")]]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema = StructType(fields)
    kinds = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary file, about 2 MB

    def run(batches):
        large_apart()
        encoder, part, seen = encoder_of_worker(shared.value), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([end_id], dtype=np.int32)
        for batch in batches:
            for rows in slices(batch, 1):
                flat, sizes = encoder.encode(rows.column(1).to_pylist())
                flat, ends = flat.astype("<u4"), np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id)
                sizes = sizes + 1
                firsts = np.cumsum(sizes) - sizes
                per_doc = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), per_doc)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * window
                length = np.minimum(window, sizes[doc] - start)
                at = firsts[doc] + start
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                nth = _occurrence(length) + seen[length]
                seen += np.bincount(length, minlength=window + 1)
                columns = [rows.column(0).take(pa.array(doc)), *[pa.array(x, type=pa.int64()) for x in
                           (start, length, crc, sizes[doc], np.full(len(doc), part), nth)]]
                if with_ids:  # pieces lie one after another
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)),
                        pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)
        give_back()

    return source.mapInArrow(run, schema)


def _occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return out


# --- plan -----------------------------------------------------------------------------------------------------------

def combinations(histogram: np.ndarray, window: int = WINDOW, most: int = MOST_COMBINATIONS) -> list[tuple[int, ...]]:
    """Shallow combinations of the lengths at hand that fill a window exactly: alone, equal ones, two, then three and
    four with the more frequent lengths, until there are ``most``."""
    have = np.flatnonzero(histogram)
    present = set(have.tolist())
    out: dict[tuple[int, ...], None] = {}
    for a in have.tolist():
        if window % a == 0 and window // a <= 64:
            out[(a,) * (window // a)] = None
        if window - a in present and a <= window - a:
            out[window - a, a] = None
    often = sorted(present - {window}, key=lambda a: (-histogram[a], a))
    for size in (3, 4):
        # a length with the many partners that leave a present one; the frequent lengths pair first
        near = often[: 160 if size == 3 else 24]
        for i, a in enumerate(often):
            if len(out) >= most:
                break
            for j, b in enumerate(near):
                if size == 3:
                    rest = window - a - b
                    if rest > 0 and rest in present:
                        out[tuple(sorted((a, b, rest), reverse=True))] = None
                    continue
                for c in near[j:]:
                    rest = window - a - b - c
                    if rest > 0 and rest in present:
                        out[tuple(sorted((a, b, c, rest), reverse=True))] = None
    return list(out)[:max(most, 1)]


def solve_counts(found: list[tuple[int, ...]], histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x least in |A x - histogram|^2, where column j of A counts the lengths of
    combination j; by projected gradient steps with momentum."""
    if not found:
        return np.zeros(0)
    flat = np.array([n for c in found for n in c])
    owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
    lengths = len(histogram)

    def forward(x):
        return np.bincount(flat, weights=x[owner], minlength=lengths)

    def back(r):
        return np.bincount(owner, weights=r[flat], minlength=len(found))

    v = np.ones(len(found))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        now = np.maximum(0, y + step * back(histogram - forward(y)))
        t_now = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = now + (t - 1) / t_now * (now - x)
        x, t = now, t_now
    return x


@dataclass(frozen=True)
class Plan:
    """Where the k-th piece of a length goes: slots in order, each for ``repeats`` pieces in a row of sequences."""
    firsts: np.ndarray        # by length: its slots are firsts[length]:firsts[length + 1]
    rank: np.ndarray          # pieces of the same length before the slot
    sequence: np.ndarray      # of the slot's first piece
    offset: np.ndarray
    sequences: int


def plan_windows(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Round the solved counts down and take them in falling order as far as pieces are left; pack the rest greedily:
    the longest piece left, then each time the longest that still fits. All in counts, not in pieces."""
    left = histogram.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []

    def take(combination: tuple[int, ...], most: int) -> None:
        need = Counter(combination)
        n = min([most, *(int(left[a]) // k for a, k in need.items())])
        if n > 0:
            made.append((combination, n))
            for a, k in need.items():
                left[a] -= k * n

    found = combinations(left, window)
    counts = solve_counts(found, left.astype(float))
    for j in np.argsort(-counts, kind="stable"):
        take(found[j], int(counts[j] + 1e-6))
    while left.any():
        room, chosen = window, []
        spare = left.copy()
        while room:
            fits = np.flatnonzero(spare[:room + 1])
            if not len(fits):
                break
            a = int(fits[-1])
            chosen.append(a)
            spare[a] -= 1
            room -= a
        take(tuple(chosen), 1 << 62)
    by_length: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
    at = 0
    for combination, n in made:
        offset = 0
        for a in combination:
            by_length[a].append((n, at, offset))
            offset += a
        at += n
    firsts = np.concatenate(([0], np.cumsum([len(s) for s in by_length])))
    rank = [x for s in by_length for x in np.cumsum([0, *(n for n, _, _ in s)])[:-1].tolist()] if at else []
    slots = [s for of in by_length for s in of]
    return Plan(firsts, np.array(rank, dtype=np.int64), np.array([s[1] for s in slots], dtype=np.int64),
                np.array([s[2] for s in slots], dtype=np.int64), at)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given by length and rank among the pieces of that length."""
    # ranks of one length rise over its slots, so (length, rank) can be looked up in one sorted array
    of = np.repeat(np.arange(len(plan.firsts) - 1), np.diff(plan.firsts))
    wide = int(max(plan.rank.max(initial=0), rank.max(initial=0))) + 1
    slot = np.searchsorted(of * wide + plan.rank, length * wide + rank, side="right") - 1
    return plan.sequence[slot] + rank - plan.rank[slot], plan.offset[slot]


# --- operator -------------------------------------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents become pieces of at most ``window`` ids (``cut_pieces``); a null or empty text is its end id alone.
    Only the histogram of lengths, ``window`` numbers, reaches the driver; the plan, bounded by the combinations
    weighed and a few for every length, goes back to the tasks. A piece's rank among those of its length is the number
    that earlier tasks made plus its own, so no length's pieces ever come together. Repeated rows are packed each, in
    no stated order; an empty table gives no sequences. Other columns of ``docs`` are not read.
    """
    pieces = stored(cut_pieces(docs, tokenizer, window, end_id, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan = plan_windows(histogram, window)
    fields = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    kinds = to_arrow_schema(schema)
    kept = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                sequence, offset = place(plan, length, rank)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                                                 schema=kinds)

    ranked = pieces.join(shifts.select("part", "length", "before"), ["part", "length"]).select(
        *kept, (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, schema)
