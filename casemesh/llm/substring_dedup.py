"""Repeated passages: every word in a window of words that also starts earlier is removed.

The repeats are found level by level, at half a window's length and at the whole length. Of the half-length windows only
anchors take part: in every whole window the one with the least hash, so that equal windows have equal anchors and no
repeat is missed. Only what is repeated at half length is extended to twice that length. An anchor's extensions are all
whole windows it is the anchor of; together they span a stretch of text, its context. Contexts that occur again settle
all their windows at once. Where one anchor has different contexts, as at the ends of a repeated passage, the contexts'
windows are compared one by one. A longer repeat covers no word that its windows leave out, so the doubling ends there,
or before if nothing survives.

Inside a task all rows but the first of equal stretches are settled before anything is shuffled, so that a passage that
a third of the documents have is one row a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from casemesh.llm.common import drawn, map_texts, own_name, sample_share, slices, stored

#: Words of a window.
WINDOW = 20
#: Rows a task holds before it settles those that are equal and hands on the rest.
HELD = 1 << 20
#: Documents looked at for anchors in more than 1 of OFTEN rows; they are dealt out by their contexts too. Nothing else
#: depends on this sample.
LOOKED_AT, OFTEN = 20_000, 1_000

_ROWS = "kind byte, g long, c long, often boolean, d long, tie long, start int, size int"
COVERED, CANDIDATE = 1, 2


# --- windows of one text --------------------------------------------------------------------------------------------

class Words:
    """The words of a text, as UTF-8 joined by single blanks, with their places."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()  # at \x20 and \x09 to \x0D
        self.joined = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def stretch(self, start: int, size: int) -> bytes:
        return self.joined[self.starts[start]:self.ends[start + size - 1]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    count = len(hashes) - size + 1
    out = np.zeros(max(count, 0), np.uint64)
    for k in range(size if count > 0 else 0):
        out = _mixed(out + hashes[k:k + count])
    return out


def contexts(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its hash, where its context starts and how many words that has; nothing for a shorter text.

    The context is the union of the windows whose least half-length hash, the leftmost of equal ones, is the anchor.
    """
    n, half = len(words.words), window - window // 2
    count = n - window + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, words.words), np.uint64, n), half)
    places = window - half + 1
    least = grams[:count].copy()
    at = np.arange(count)
    for k in range(1, places):
        lower = grams[k:k + count] < least
        least[lower] = grams[k:k + count][lower]
        at[lower] = np.flatnonzero(lower) + k
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], count) - 1
    return grams[at[first]], first, last + window - first


# --- equal stretches ------------------------------------------------------------------------------------------------

class _Stretches:
    """Rows (g, c, d, tie, start, size, often) of a task; equal (g, c) means equal stretches."""

    NAMES = ("kind", "g", "c", "often", "d", "tie", "start", "size")

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, g, c, d, tie, start, size, often) -> None:
        self.parts.append((g, c, d, tie, start, size, often))
        self.rows += len(g)

    def settled(self):
        """Batches with the earliest row of every stretch, and as covered the words of the others."""
        if not self.rows:
            return
        g, c, d, tie, start, size, often = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.__init__()
        order = np.lexsort((start, tie, d, c, g))
        g, c, d, tie, start, size, often = (x[order] for x in (g, c, d, tie, start, size, often))
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (d != d[first]) | (tie != tie[first]) | (start != start[first])
        yield from _batches(np.full(len(first), CANDIDATE, np.int8), g, c, often, d, tie, start, size, new)
        yield from _batches(*_merged(d[again], tie[again], start[again], size[again]))


def _merged(d, tie, start, size):
    """Covered words as runs without overlaps, as columns of rows."""
    order = np.lexsort((start, tie, d))
    d, tie, start, size = d[order], tie[order], start[order], size[order]
    end = start + size
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (tie[1:] != tie[:-1])))[:len(d)]
    # ends grow with starts inside a document up to one's own length; a running maximum over offset documents joins them
    shift = (np.cumsum(new) - 1) * (int(end.max()) + 1 if len(end) else 1)
    reach = np.maximum.accumulate(end + shift) if len(end) else end
    new[1:] |= (start + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1 if len(at) else at
    zero = np.zeros(len(at), np.uint64)
    return (np.full(len(at), COVERED, np.int8), zero, zero, np.zeros(len(at), bool), d[at], tie[at], start[at],
            (reach - shift)[last] - start[at], np.ones(len(at), bool))


def _batches(kind, g, c, often, d, tie, start, size, keep):
    at = np.flatnonzero(keep)
    for k in range(0, len(at), 1 << 16):
        some = at[k:k + (1 << 16)]
        columns = (kind[some], g[some].view(np.int64), c[some].view(np.int64), often[some], d[some], tie[some],
                   start[some].astype(np.int32), size[some].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_Stretches.NAMES)


def _later(rows: DataFrame) -> DataFrame:
    """(kind, d, tie, start, size): as COVERED all but the earliest of equal stretches, and what was covered before; as
    CANDIDATE the earliest ones where the same ``g`` has different stretches.

    Rows stream by in order; one row is remembered.
    """
    def run(batches):
        g0 = c0 = None  # of the row before
        first: tuple = ()  # the earliest row of its stretch: d, tie, start, size
        waiting = False  # that row is the only stretch of its g as yet
        for batch in batches:
            kind, g, c, often, d, tie, start, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            old = kind == COVERED
            out = [(np.full(int(old.sum()), COVERED, np.int8), d[old], tie[old], start[old], size[old])]
            g, c, often, d, tie, start, size = (x[~old] for x in (g, c, often, d, tie, start, size))
            n = len(g)
            if n:
                new_g = np.concatenate(([g0 is None or g[0] != g0], g[1:] != g[:-1]))
                new = new_g | np.concatenate(([c0 is None or c[0] != c0], c[1:] != c[:-1]))
                at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                lead = [np.where(at >= 0, x[at], first[k] if first else 0) for k, x in enumerate((d, tie, start))]
                again = (d != lead[0]) | (tie != lead[1]) | (start != lead[2])
                out.append((np.full(int(again.sum()), COVERED, np.int8), *(x[again] for x in (d, tie, start, size))))
                of = np.cumsum(new_g)  # 0: the g of the batch before goes on
                stretches = np.bincount(of[new], minlength=int(of[-1]) + 1)
                if waiting and stretches[0]:
                    out.append((np.full(1, CANDIDATE, np.int8), *(np.array([x], y.dtype) for x, y in zip(first, (d, tie, start, size), strict=True))))
                several = stretches > 1
                several[0] = True  # it had one before
                chosen = new & (several[of] | often)
                out.append((np.full(int(chosen.sum()), CANDIDATE, np.int8), *(x[chosen] for x in (d, tie, start, size))))
                if of[-1] == 0:
                    waiting = waiting and not stretches[0]
                else:
                    waiting = bool(stretches[-1] == 1 and not often[-1])
                if new.any():
                    k = int(at[-1])
                    first = (d[k], tie[k], start[k], size[k])
                g0, c0 = g[-1], c[-1]
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "d", "tie", "start", "size"])

    # covered rows only pass by; they are spread by their places
    key = (F.when(F.col("kind") == COVERED, F.xxhash64("d", "start")).when(F.col("often"), F.xxhash64("g", "c"))
           .otherwise(F.xxhash64("g")))
    placed = rows.repartition(key).sortWithinPartitions("g", "c", "d", "tie", "start")
    return placed.mapInArrow(run, "kind byte, d long, tie long, start int, size int")


# --- documents ------------------------------------------------------------------------------------------------------

def _numbers(docs: DataFrame) -> tuple[Column, bool]:
    """The order of documents as a long, and whether it leaves some undecided, which their texts then decide."""
    doc_id = docs["`doc_id`"].cast("long")
    twice = docs.groupBy("`doc_id`").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    return F.coalesce(doc_id, F.lit(-(1 << 63))), twice.limit(1).count() > 0


def _tie(text: str | None, tied: bool) -> int:
    if not tied:
        return 0
    value = xxhash.xxh64_intdigest((text or "").encode(), 3)
    return value - (1 << 63)


def _anchors(docs: DataFrame, d: Column, tied: bool, window: int, often: list[int]) -> DataFrame:
    """One row for every anchor of every text that its task has not settled, and the words it has."""
    frequent = np.array(sorted(often), np.int64).view(np.uint64)

    def run(batches):
        held = _Stretches()
        for batch in batches:
            for part in slices(batch, 1):
                for number, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = Words(text)
                    g, start, size = contexts(words, window)
                    if not len(g):
                        continue
                    begin, end, joined = words.starts[start].tolist(), words.ends[start + size - 1].tolist(), words.joined
                    c = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(begin, end, strict=True)), np.uint64, len(g))
                    held.add(g, c, np.full(len(g), number), np.full(len(g), _tie(text, tied)), start, size, np.isin(g, frequent))
                    if held.rows > HELD:
                        yield from held.settled()
        yield from held.settled()
        pa.default_memory_pool().release_unused()

    return docs.select(d.alias("d"), docs["`text`"].cast("string").alias("t")).mapInArrow(run, _ROWS)


def _often(docs: DataFrame, d: Column, window: int) -> list[int]:
    """Anchors in more than one of OFTEN rows of a sample of documents: fewer than OFTEN."""
    share = sample_share(docs.count(), LOOKED_AT)
    counted = _anchors(docs.where(drawn(d, share, 13)), d, False, window, []).where(F.col("kind") == CANDIDATE)
    counted = stored(counted.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    return [r["g"] for r in counted.where(F.col("n") * OFTEN > counted.agg(F.sum("n")).scalar()).select("g").collect()]


def _packed(docs: DataFrame, d: Column, tied: bool, keep: list[str]) -> DataFrame:
    """``keep``, (d, tie) and the compressed text, as texts are shuffled to what was found in them."""
    def make():
        pack = zstandard.ZstdCompressor(level=3)

        def work(texts):
            return [[_tie(t, tied) for t in texts], pa.array([pack.compress((t or "").encode()) for t in texts], pa.binary())]
        return work

    hidden = own_name()
    out = StructType().add("tie", "long").add("z", "binary")
    return map_texts(docs.withColumn(hidden, d), [hidden, *keep], out, make).withColumnRenamed(hidden, "d")


def _windows(packed: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """One row for every window of the candidate stretches, by the 128-bit digest of its words."""
    lists = candidates.groupBy("d", "tie").agg(F.collect_list("start").alias("start"), F.collect_list("size").alias("size"))
    rows = packed.select("d", "tie", "z").join(lists, ["d", "tie"])

    def run(batches):
        open_up, held = zstandard.ZstdDecompressor(), _Stretches()
        for batch in batches:
            for d, tie, z, starts, sizes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                words = Words(open_up.decompress(z).decode())
                at = np.unique(np.concatenate([np.arange(s, s + n - window + 1) for s, n in zip(starts, sizes, strict=True)]))
                begin, end, joined = words.starts[at].tolist(), words.ends[at + window - 1].tolist(), words.joined
                both = b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(begin, end, strict=True)])
                both = np.frombuffer(both, np.uint64).reshape(-1, 2)
                n = len(at)
                held.add(both[:, 0], both[:, 1], np.full(n, d), np.full(n, tie), at, np.full(n, window), np.zeros(n, bool))
                if held.rows > HELD:
                    yield from held.settled()
        yield from held.settled()
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, _ROWS)


def repeated_words(docs: DataFrame, window: int = WINDOW, packed: DataFrame | None = None) -> DataFrame:
    """(d, tie, start, size): runs of words covered by windows that also start earlier; they may overlap."""
    d, tied = _numbers(docs)
    packed = _packed(docs, d, tied, []) if packed is None else packed
    half = stored(_later(_anchors(docs, d, tied, window, _often(docs, d, window))), "half-windows")
    found = half.where(F.col("kind") == COVERED)
    survivors = half.where(F.col("kind") == CANDIDATE)
    if survivors.limit(1).count():
        whole = stored(_later(_windows(packed, survivors, window)), "whole-windows")
        found = found.unionByName(whole.where(F.col("kind") == COVERED))
    return found.select("d", "tie", "start", "size")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row with ``n_words``, ``removed`` and ``kept_text``.

    A word is a run of characters other than ``\\x20`` and ``\\x09`` to ``\\x0D``. It is removed if some ``window``
    consecutive words that cover it also start at an earlier place: in a document with a smaller doc_id or earlier in its
    own; windows are those of the input. ``removed`` are the runs of removed words as word numbers, end exclusive, in
    order and apart; ``kept_text`` is the other words joined by one blank.

    A null doc_id comes before all others. Texts that share a doc_id are documents in the order of a digest; rows alike in
    doc_id and text are one document and get the same result. Null, empty and blank texts have no words; texts shorter than a window
    lose none. An empty table gives no rows. Other columns are read only if kept.
    """
    keep = keep or ["doc_id"]
    d, tied = _numbers(docs)
    packed = _packed(docs, d, tied, keep)
    hidden = [own_name() for _ in keep]
    runs = repeated_words(docs, window).groupBy("d", "tie").agg(
        F.collect_list("start").alias("start"), F.collect_list("size").alias("size"))
    named = packed.toDF("d", *hidden, "tie", "z")
    rows = named.join(runs, ["d", "tie"], "left").select(*hidden, "z", "start", "size")
    fields = [StructField(h, named.schema[h].dataType) for h in hidden]
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("removed", ArrayType(span)),
                         StructField("kept_text", StringType())])

    def run(batches):
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, len(keep)):
                counts, spans, kept = [], [], []
                for z, starts, sizes in zip(*(part.column(len(keep) + k).to_pylist() for k in range(3)), strict=True):
                    words = open_up.decompress(z).split()
                    edges = np.zeros(len(words) + 1, np.int64)
                    if starts:
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, np.add(starts, sizes), -1)
                    gone = np.cumsum(edges)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    counts.append(len(words))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                    left = words if not starts else [words[k] for k in np.flatnonzero(~gone)]
                    kept.append(b" ".join(left).decode())
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                       pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *new], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, "n_words", "removed", "kept_text")
