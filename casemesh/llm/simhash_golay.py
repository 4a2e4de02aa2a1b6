"""Near-duplicate groups: 64-bit SimHash fingerprints linked through Golay-code keys.

A fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at most three bits, two
of their three segments differ in at most one bit each (the errors 3 = 3+0+0 = 2+1+0 = 1+1+1 leave no other way). The
binary Golay code of length 23 is perfect: every word lies within three bits of one codeword, whose 12 message bits
are the word's index. The indices of a segment and of its one-bit neighbours are one value if the segment is within
two bits of its codeword, and six values (fewer for a shorter segment) if it is three bits away; the index of any
segment one bit off is among them. For each of the three segment pairs a fingerprint gives the keys (an index near
its first segment, the own index of its second) as *left* and (own index of the first, an index near the second) as
*right*. Two fingerprints with one error or none in both segments meet left to right under
(index of b's first, index of a's second). Fingerprints that meet are verified by their real distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casemesh.llm.common import map_texts, own_name, quoted, stored
from casemesh.llm.components import connected_components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: Members of a key that are compared at once; a larger key is dealt out in blocks of about this many.
BLOCK = 2_048


# --- fingerprints ---------------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """Hashes of the word shingles of a whole text in their order; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes lower A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    if count == 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:count].tolist(), ends[width - 1:].tolist(),
                                                                strict=True)), dtype=np.uint64, count=count)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a whole text, unsigned; zero without words."""
    hashes = shingle_hashes(text, width)
    count = len(hashes)
    if not count:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # a long text's bits are counted in runs
        run = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(run, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) for every row; null texts have fingerprint zero."""
    def make():
        return lambda texts: [pa.array([signed(fingerprint(t, width)) for t in texts], type=pa.int64())]

    return map_texts(docs, ["doc_id"], StructType([StructField("fp", LongType())]), make)


def as_hex(column: str):
    """16 lowercase hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))  # hex gives at most 16 digits, so nothing is cut


# --- Golay keys -----------------------------------------------------------------------------------------------------

def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words on division by the generator: 11 bits, the syndrome."""
    rest = values.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper and lower 12 bits of a word, and the error of weight at most three of each syndrome."""
    high, low = _remainders(np.arange(1 << 11) << 12), _remainders(np.arange(1 << 12))
    bits = 1 << np.arange(23, dtype=np.int64)
    one, zero = bits, np.zeros(1, np.int64)
    two = (bits[:, None] | bits)[np.triu_indices(23, 1)]
    three = (bits[:, None, None] | bits[None, :, None] | bits)
    i, j, k = np.meshgrid(range(23), range(23), range(23), indexing="ij")
    errors = np.concatenate([zero, one, two, three[(i < j) & (j < k)]])
    table = np.zeros(1 << 11, np.int64)
    table[_remainders(errors)] = errors
    return high, low, table


def decode(words: np.ndarray, tables) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    high, low, errors = tables
    return (words ^ errors[high[words >> 12] ^ low[words & 4095]]) >> 11


def _near(segment: np.ndarray, bits: int, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own index, and as (row, index) without repeats all indices within one bit of each segment."""
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
    around = decode(segment[:, None] ^ flips, tables)
    pairs = np.unique((np.arange(len(segment))[:, None] << 12 | around).ravel())
    return around[:, 0], pairs >> 12, pairs & 4095


def golay_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) for unsigned fingerprints; side 1 left, 2 right, 3 both; no repeats."""
    near = [_near((fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64), bits, tables)
            for shift, bits in SEGMENTS]
    rows, keys, sides = [], [], []
    for number, (a, b) in enumerate(PAIRS):
        (own_a, row_a, near_a), (own_b, row_b, near_b) = near[a], near[b]
        left = number << 24 | near_a << 12 | own_b[row_a]
        right = number << 24 | own_a[row_b] << 12 | near_b
        meets_a, meets_b = near_a == own_a[row_a], near_b == own_b[row_b]
        rows += [row_a, row_b[~meets_b]]
        keys += [left, right[~meets_b]]
        sides += [np.where(meets_a, 3, 1), np.full(int((~meets_b).sum()), 2)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def with_keys(fps: DataFrame) -> DataFrame:
    """``(k, side, fp)``: the 32 or fewer keys of every distinct fingerprint."""
    def run(batches):
        tables = golay_tables()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 20_000):
                values = whole[at:at + 20_000]
                row, key, side = golay_keys(values.view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(side.astype(np.int8)),
                                                  pa.array(values[row])], names=["k", "side", "fp"])

    return fps.select("fp").mapInArrow(run, "k long, side byte, fp long")


# --- links ----------------------------------------------------------------------------------------------------------

def _forest(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member reachable from each of ``size`` members over the links u-v."""
    least = np.arange(size)
    while len(u):
        lower = np.minimum(least[u], least[v])
        now = least.copy()
        np.minimum.at(now, u, lower)
        np.minimum.at(now, v, lower)
        np.minimum.at(now, least[u], lower)
        np.minimum.at(now, least[v], lower)
        now = now[now]
        if np.array_equal(now, least):
            break
        least = now
    return least


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at ``bits`` or fewer bits inside each group; rows come sorted by group.

    Rows are compared with the row one, two, three ... places further on while that is in the same group, so the
    work arrays never exceed the rows given.
    """
    us, vs = [], []
    at, lag = np.arange(len(group)), 1
    while len(at):
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        to = at + lag
        near = (side[at] | side[to]) == 3
        near &= np.bitwise_count(fp[at] ^ fp[to]) <= bits
        us.append(at[near])
        vs.append(to[near])
        if sum(map(len, us)) > 1 << 20:  # keep a forest of what is there
            least = _forest(len(group), np.concatenate(us), np.concatenate(vs))
            us, vs = [np.flatnonzero(least < np.arange(len(group)))], [least[least < np.arange(len(group))]]
        lag += 1
    least = _forest(len(group), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(group))
    child = np.flatnonzero(least < np.arange(len(group)))
    a, b = fp[child].view(np.int64), fp[least[child]].view(np.int64)
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) among distinct fingerprints whose components are those of all links at ``bits`` (3 at most) bits.

    Inside a key only a spanning forest of the verified links is given out, so a key of m members gives fewer than m
    rows. A key of more than ``block`` members is cut by a hash into parts of about that size and every two parts
    meet in a task of their own: all members are compared, and no task holds more than two parts.
    """
    if bits > 3:
        raise ValueError("three segments bound the errors of three bits only")
    keys = stored(with_keys(fps), "golay-keys")
    large = (keys.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block)
             .select("k", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    some = keys.join(large, "k", "left")
    plain = some.where("parts is null").select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), "side", "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (some.where("parts is not null").withColumn("p", own)
             .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("k", (F.least("p", "q") + 1).alias("i"), (F.greatest("p", "q") + 1).alias("j"), "side", "fp"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            k, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            ends = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            first = held and [held[-1].column(c)[-1].as_py() for c in range(3)] == [x[0] for x in (k, i, j)]
            if held and not first:
                yield from _met(held, bits)
                held = []
            if len(ends):
                last = int(ends[-1])
                yield from _met([*held, batch.slice(0, last)], bits)
                held = [batch.slice(last)]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield from _met(held, bits)

    together = plain.unionByName(dealt).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")
    return together.mapInArrow(run, "u long, v long").distinct()


def _met(batches: list[pa.RecordBatch], bits: int):
    table = pa.Table.from_batches(batches).combine_chunks()
    k, i, j, side, fp = (table.column(c).to_numpy() for c in range(5))
    new = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.concatenate(([0], np.cumsum(new)))
    u, v = _links(group, side.astype(np.int64), fp.astype(np.int64).view(np.uint64), bits)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def near_groups(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` and ``component`` for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id reachable over links between fingerprints at ``bits`` or fewer bits, itself
    included; copies share a fingerprint and are never paired with one another. Null, empty and blank texts all have
    fingerprint zero and are linked like others; rows with a null doc_id take part, their id never names a group, and
    a group of only such rows has a null id; ``component``, the least fingerprint as a signed long, always names the
    group. Repeated rows stay. Other columns of ``docs`` are not read.
    """
    prints = stored(with_fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    nodes = stored(nodes, "distinct-fingerprints")
    found = connected_components(links(nodes, bits))
    grouped = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    least = grouped.where("component is not null").groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = grouped.where("component is not null").join(least, "component").select("fp", "component_id", "component")
    alone = grouped.where("component is null").select("fp", F.col("least_id").alias("component_id"),
                                                      F.col("fp").alias("component"))
    return prints.join(linked.unionByName(alone), "fp").select("doc_id", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one document of every near-duplicate group: the one with the least doc_id.

    Rows that share a doc_id are one document; the first by its text stays. A group without any id keeps the row with
    the least text.
    """
    return pick_first(docs, stored(near_groups(docs, width, bits), "near-groups"), lambda t: signed(fingerprint(t, width)))


def pick_first(docs: DataFrame, groups: DataFrame, digest: Callable[[str | None], int]) -> DataFrame:
    """One row of ``docs`` for each component of ``groups`` (as of ``near_groups``); ``digest`` gives a text's ``fp``."""
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    single, repeated = kept.where("n = 1").select("doc_id"), kept.where("n > 1").select("doc_id")
    hidden, rank = own_name(), own_name()
    first = Window.partitionBy("doc_id").orderBy("text")
    of_repeated = (docs.join(repeated, "doc_id", "left_semi").withColumn(rank, F.row_number().over(first))
                   .where(F.col(rank) == 1).drop(rank))
    if docs.where("doc_id is null").limit(1).count() == 0:
        return docs.join(single, "doc_id", "left_semi").select(quoted(docs)).unionByName(of_repeated.select(quoted(docs)))
    nameless = map_texts(docs.where("doc_id is null"), docs.columns, StructType([StructField(hidden, LongType())]),
                         lambda: lambda texts: [pa.array([digest(t) for t in texts], type=pa.int64())])
    only = groups.where("component_id is null").select(F.col("fp").alias(hidden), "component").distinct()
    only = only.withColumnRenamed("component", rank)
    least = Window.partitionBy(rank).orderBy("text")
    place = own_name()
    of_nameless = nameless.join(only, hidden).withColumn(place, F.row_number().over(least)).where(F.col(place) == 1)
    return (docs.join(single, "doc_id", "left_semi").select(quoted(docs)).unionByName(of_repeated.select(quoted(docs)))
            .unionByName(of_nameless.select(quoted(docs))))
