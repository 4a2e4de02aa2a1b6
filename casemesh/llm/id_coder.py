"""Token ids as files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Every block of at most BLOCK ids is coded by itself, from the same fresh model. For each id

* the two ids before it (order 2) and the one before it (order 1) each point to a slot with the id last seen there and
  how sure the slot is; whether the id is the first prediction, the second, or neither, is coded with the mixed counts
  of two contexts, the two confidences and the last two outcomes;
* if neither, its magnitude (floor(log2(id + 1))) is coded with the mixed counts of order 0 and of the magnitude
  before (order 1), and the rest of its bits evenly.

Mixing adds the counts, so the context with more evidence weighs more. Counts, slots and confidences adapt after each
id. The coder keeps a 64-bit low end and range and gives out 16 bits at a time. A task codes the blocks of a frame
side by side: one array element for each block, one step for each id.

Block: count, number of 16-bit words, crc32 of both and the words (three little-endian unsigned 32-bit numbers), then
the words. Frame (one row of the file): the documents' ids and sizes, and their blocks one after another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from casemesh.llm.common import own_name, shared_folder, slices
from casemesh.llm.library_ids import encoder_of_worker

#: Ids of a block, ids after which a frame is closed.
BLOCK, FRAME = 2_048, 8 << 20
MAX_ID = (1 << 16) - 2
HEAD, HEAD_BYTES = "<III", 12

_U = np.uint64
_TOP, _BOTTOM, _WORD = _U(1 << 48), _U(1 << 40), _U(16)
_NO_ID = (1 << 16) - 1          # of a slot that has seen nothing
_SLOT_BITS = (11, 10)
_FIELD = _U(0xFFFF)
#: Three counts and their sum share one 64-bit number, 16 bits each, so that adding two numbers mixes two contexts.
_EVEN = _U(1 | 1 << 16 | 1 << 32 | 3 << 48)
_STEP, _FULL = 24, _U(700 << 48)
_ADD = np.array([_STEP << 16 * k | _STEP << 48 for k in range(3)], dtype=_U)
_AT_FIELD = np.array([0, 16, 32], dtype=_U)
#: Magnitudes are kept as 16 rising sums; a step adds to the sums from a magnitude on.
_WIDE = 16
_EVEN_SUMS = np.arange(2, 2 * _WIDE + 2, 2, dtype=np.uint16)
_ADD_SUMS = (np.arange(_WIDE) >= np.arange(_WIDE)[:, None]).astype(np.uint16) * np.uint16(_STEP)
_FULL_SUMS = 1_500
_MAGNITUDE = np.repeat(np.arange(17), [1 << k for k in range(17)])[:1 << 16]  # of v at v - 1


class _Model:
    """The adaptive state of ``n`` blocks; ``m`` below is how many of them still go on."""

    def __init__(self, n: int):
        self.slots = [np.full(n << bits, _NO_ID, np.uint32) for bits in _SLOT_BITS]
        self.by_sure, self.by_past = np.zeros(n * 16, _U), np.zeros(n * 9, _U)
        self.order0, self.order1 = np.zeros((n, _WIDE), np.uint16), np.zeros((n * _WIDE, _WIDE), np.uint16)
        lane = np.arange(n)
        self.lane_slots = [lane << bits for bits in _SLOT_BITS]
        self.lane_sure, self.lane_past, self.lane_size = lane * 16, lane * 9, lane * _WIDE
        self.one, self.two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)  # the ids before, plus one
        self.past, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, m: int) -> np.ndarray:
        """The mixed counts of first prediction, second, and neither, packed."""
        mixed = self.one[:m] * np.uint32(0x9E3779B1)
        both = (mixed ^ (self.two[:m] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        self.at = [lane[:m] + (h >> np.uint32(32 - bits)) for lane, h, bits in
                   zip(self.lane_slots, (both, mixed), _SLOT_BITS, strict=True)]
        self.held = [slots.take(at) for slots, at in zip(self.slots, self.at, strict=True)]
        self.guess = [h & np.uint32(0xFFFF) for h in self.held]
        sure = (self.held[0] >> np.uint32(16) << np.uint32(2)) | self.held[1] >> np.uint32(16)
        self.row_sure, self.row_past = self.lane_sure[:m] + sure, self.lane_past[:m] + self.past[:m]
        self.was_sure, self.was_past = self.by_sure.take(self.row_sure), self.by_past.take(self.row_past)
        return self.was_sure + self.was_past + _EVEN

    def magnitudes(self, lanes: np.ndarray) -> np.ndarray:
        """Rising sums of the mixed counts of the magnitudes, for the blocks ``lanes``."""
        self.row_size = self.lane_size[lanes] + self.size[lanes]
        self.was0, self.was1 = self.order0.take(lanes, axis=0), self.order1.take(self.row_size, axis=0)
        return self.was0 + self.was1 + _EVEN_SUMS

    def learn(self, m: int, ids: np.ndarray, outcome: np.ndarray, lanes: np.ndarray, size: np.ndarray) -> None:
        """Take in the ids coded last (uint32); ``lanes`` are those coded by magnitude, with their ``size``."""
        add = _ADD[outcome]
        for table, rows, was in ((self.by_sure, self.row_sure, self.was_sure), (self.by_past, self.row_past, self.was_past)):
            was += add
            if len(full := np.flatnonzero(was > _FULL)):
                was[full] = _halved(was[full])
            table[rows] = was
        more = _ADD_SUMS[size]
        for table, rows, was in ((self.order0, lanes, self.was0), (self.order1, self.row_size, self.was1)):
            was += more
            if len(full := np.flatnonzero(was[:, -1] > _FULL_SUMS)):
                was[full] >>= 1
            table[rows] = was
        self.past[:m] = self.past[:m] % 3 * 3 + outcome
        self.size[lanes] = size
        for slots, at, held, guess in zip(self.slots, self.at, self.held, self.guess, strict=True):
            sure = held >> np.uint32(16)
            right = guess == ids
            # right: one surer, three at most; wrong: one less sure, and at the bottom the new id takes the slot
            slots[at] = np.where(right, held + (sure < 3).astype(np.uint32) * np.uint32(1 << 16),
                                 np.where(sure > 0, held - np.uint32(1 << 16), ids))
        self.two[:m] = self.one[:m]
        self.one[:m] = ids + np.uint32(1)


def _halved(packed: np.ndarray) -> np.ndarray:
    half = packed >> _U(1) & _U(0x7FFF7FFF7FFF)
    return half | (half & _FIELD) + (half >> _U(16) & _FIELD) + (half >> _U(32)) << _U(48)


def _narrowed(low: np.ndarray, width: np.ndarray, m: int):
    """Again and again the blocks whose upper 16 bits are settled, or whose range has become too narrow, before their
    low end and range are moved up by 16 bits."""
    end = low[:m] + width[:m]
    at = np.flatnonzero(((low[:m] ^ end) < _TOP) | (width[:m] < _BOTTOM))
    while len(at):
        near, wide = low[at], width[at]
        yield at, near
        unsettled = (near ^ (near + wide)) >= _TOP  # narrow across a border: end at the border
        if unsettled.any():
            wide = np.where(unsettled, (~near + _U(1)) & (_BOTTOM - _U(1)), wide)
        near, wide = near << _WORD, wide << _WORD
        low[at], width[at] = near, wide
        at = at[((near ^ (near + wide)) < _TOP) | (wide < _BOTTOM)]


def _columns(count: int) -> tuple[int, int]:
    blocks = -(-count // BLOCK)
    return blocks, count - (blocks - 1) * BLOCK


def encode_ids(ids: np.ndarray) -> bytes:
    """The blocks of a run of ids (0 to MAX_ID); blocks are full but for the last."""
    count = len(ids)
    if not count:
        return b""
    if int(ids.max()) > MAX_ID or int(ids.min()) < 0:
        raise ValueError(f"ids must lie between 0 and {MAX_ID}")
    n, last = _columns(count)
    grid = np.zeros(n * BLOCK, np.uint32)
    grid[:count] = ids
    grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    model, low, width = _Model(n), np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
    words, used = np.zeros((n, 2 * BLOCK + 16), np.uint16), np.zeros(n, np.int64)
    for t in range(BLOCK if n > 1 else last):
        m = n if t < last else n - 1
        x = grid[t, :m]
        counts = model.predict(m)
        first = model.guess[0] == x
        outcome = np.where(first, 0, 2 - (model.guess[1] == x))
        first_count = counts & _FIELD
        sums = (first_count << _U(16)) | (first_count + (counts >> _U(16) & _FIELD)) << _U(32)
        shift = _AT_FIELD[outcome]
        unit = width[:m] // (counts >> _U(48))
        low[:m] += (sums >> shift & _FIELD) * unit
        width[:m] = (counts >> shift & _FIELD) * unit
        lanes = np.flatnonzero(outcome == 2)
        value = x[lanes]
        size = _MAGNITUDE[value]
        sums, pick = model.magnitudes(lanes), np.arange(len(lanes)) * _WIDE + size
        upto = sums.take(pick).astype(_U)
        before = np.where(size > 0, sums.take(pick - (size > 0)), 0).astype(_U)
        unit = width[lanes] // sums[:, -1].astype(_U)
        wide_size = size.astype(_U)
        part = (upto - before) * unit >> wide_size
        low[lanes] += before * unit + (value.astype(_U) + _U(1) - (_U(1) << wide_size)) * part
        width[lanes] = part
        model.learn(m, x, outcome, lanes, size)
        for at, near in _narrowed(low, width, m):
            words[at, used[at]] = (near >> _U(48)).astype(np.uint16)
            used[at] += 1
    end = low + width - _U(1)  # 32 bits of it name a number inside the range, as that is 2^40 wide
    each = np.arange(n)
    words[each, used] = (end >> _U(48)).astype(np.uint16)
    words[each, used + 1] = (end >> _U(32) & _FIELD).astype(np.uint16)
    out = []
    for k in range(n):
        body = words[k, :used[k] + 2].astype("<u2").tobytes()
        sizes = (BLOCK if k < n - 1 else last, len(body) // 2)
        out.append(struct.pack(HEAD, *sizes, zlib.crc32(body, zlib.crc32(struct.pack("<II", *sizes)))) + body)
    return b"".join(out)


def decode_ids(raw: bytes) -> np.ndarray:
    """The ids (uint32) of blocks written by ``encode_ids``; an error if a block is damaged."""
    view, at, bodies, counts = memoryview(raw), 0, [], []
    while at < len(raw):
        if at + HEAD_BYTES > len(raw):
            raise ValueError("a block's head is cut off")
        count, size, crc = struct.unpack_from(HEAD, raw, at)
        body = view[at + HEAD_BYTES:at + HEAD_BYTES + 2 * size]
        if len(body) != 2 * size or zlib.crc32(body, zlib.crc32(struct.pack("<II", count, size))) != crc:
            raise ValueError("a block is damaged")
        counts.append(count)
        bodies.append(np.frombuffer(body, "<u2"))
        at += HEAD_BYTES + 2 * size
    if not counts:
        return np.zeros(0, np.uint32)
    n, last = len(counts), counts[-1]
    if any(c != BLOCK for c in counts[:-1]) or not 0 < last <= BLOCK:
        raise ValueError("only the last block may be short")
    words = np.zeros((n, max(map(len, bodies)) + 8), np.uint16)  # zeros follow the last word
    for k, body in enumerate(bodies):
        words[k, :len(body)] = body
    code = np.zeros(n, _U)
    for k in range(4):
        code = code << _WORD | words[:, k].astype(_U)
    stride = words.shape[1]
    read, flat, stop = np.arange(n) * stride + 4, words.ravel(), np.arange(1, n + 1) * stride - 1
    grid = np.zeros((BLOCK, n), np.uint32)
    model, low, width = _Model(n), np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
    for t in range(BLOCK if n > 1 else last):
        m = n if t < last else n - 1
        counts = model.predict(m)
        first_count = counts & _FIELD
        border = first_count + (counts >> _U(16) & _FIELD)
        unit = width[:m] // (counts >> _U(48))
        value = (code[:m] - low[:m]) // unit  # rounding may leave it at the sum: then neither
        outcome = (value >= first_count).astype(np.int64) + (value >= border)
        shift = _AT_FIELD[outcome]
        low[:m] += ((first_count << _U(16) | border << _U(32)) >> shift & _FIELD) * unit
        width[:m] = (counts >> shift & _FIELD) * unit
        x = np.where(outcome == 0, model.guess[0], model.guess[1])
        lanes = np.flatnonzero(outcome == 2)
        sums = model.magnitudes(lanes)
        total = sums[:, -1].astype(_U)
        unit = width[lanes] // total
        ahead = code[lanes] - low[lanes]
        value = np.minimum(ahead // unit, total - _U(1)).astype(np.uint16)
        size = (sums <= value[:, None]).view(np.int8).sum(axis=1, dtype=np.int64)
        pick = np.arange(len(lanes)) * _WIDE + size
        before = np.where(size > 0, sums.take(pick - (size > 0)), 0).astype(_U)
        wide_size = size.astype(_U)
        part = (sums.take(pick).astype(_U) - before) * unit >> wide_size
        skipped = before * unit
        rest = np.minimum((ahead - skipped) // part, (_U(1) << wide_size) - _U(1))
        low[lanes] += skipped + rest * part
        width[lanes] = part
        x[lanes] = (rest + (_U(1) << wide_size) - _U(1)).astype(np.uint32)
        grid[t, :m] = x
        model.learn(m, x, outcome, lanes, size)
        for at_, _ in _narrowed(low, width, m):
            code[at_] = code[at_] << _WORD | flat.take(np.minimum(read[at_], stop[at_])).astype(_U)
            read[at_] += 1
    return grid.T.ravel()[:(n - 1) * BLOCK + last]


# --- files ----------------------------------------------------------------------------------------------------------

def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, frame: int = FRAME) -> None:
    """Write the ids of every document and its end id in ascending doc_id order as files under ``path``.

    One range shuffle of the texts; every range becomes one file of frames, written through Spark, so a lost task is
    repeated as a whole. Null ids come first; rows with one doc_id stand in the order of their texts; a null text
    counts as empty. An empty table gives files without frames. Other columns of ``docs`` are not read.
    """
    spark, hidden = docs.sparkSession, own_name()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = (docs.select("doc_id", docs["text"].cast("string").alias(hidden))
              .repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", hidden))
    kind = source.schema["doc_id"].dataType
    schema = StructType([StructField("part", LongType()), StructField("first", LongType()),
                         StructField("doc_ids", ArrayType(kind)), StructField("sizes", ArrayType(LongType())),
                         StructField("blocks", BinaryType())])
    kinds = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file, about 2 MB

    def run(batches):
        encoder, part, first = encoder_of_worker(shared.value), TaskContext.get().partitionId(), 0
        docs_held, sizes_held, ids_held, count = [], [], [], 0

        def close():
            names = pa.chunked_array(docs_held).combine_chunks()
            names = names if isinstance(names, pa.Array) else names.chunk(0)
            sizes = np.concatenate(sizes_held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], type=pa.int64()), pa.array([first], type=pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(names)], type=pa.int32()), names),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], type=pa.int32()), pa.array(sizes)),
                pa.array([encode_ids(np.concatenate(ids_held))], type=pa.binary())], schema=kinds)

        for batch in batches:
            for rows in slices(batch, 1):
                flat, sizes = encoder.encode(rows.column(1).to_pylist())
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                docs_held.append(rows.column(0))
                sizes_held.append(sizes + 1)
                ids_held.append(flat)
                count += len(flat)
                if count >= frame:
                    yield close()
                    first += count
                    docs_held, sizes_held, ids_held, count = [], [], [], 0
        if count:
            yield close()

    source.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` its ids.

    ``start`` counts the ids of all documents before it. Every block is decoded by itself and checked.
    """
    frames = spark.read.parquet(path)
    kind = frames.schema["doc_ids"].dataType.elementType
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = frames.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shifts = (sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row a file
              .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "before"))
    fields = [StructField("part", LongType()), StructField("doc_id", kind), StructField("start", LongType()),
              StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(LongType())))
    schema = StructType(fields)
    kinds = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, names, sizes, blocks = (batch.column(c)[row] for c in
                                                     ("part", "first", "doc_ids", "sizes", "blocks"))
                ids = decode_ids(blocks.as_py())
                n = sizes.values.to_numpy(zero_copy_only=False)
                if int(n.sum()) != len(ids):
                    raise ValueError("a frame has another number of ids than its documents")
                ends = np.cumsum(n)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array(np.full(len(n), part.as_py())), names.values, pa.array(ends - n + first.as_py()),
                           pa.array(n), pa.array(crc, type=pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)),
                                                            pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    rows = frames.mapInArrow(run, schema).join(shifts, "part")
    return rows.withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def ids_path(spark: SparkSession) -> str:
    """A fresh folder for the files in the shared folder."""
    return f"{shared_folder(spark)}/llm/ids{own_name()}"
