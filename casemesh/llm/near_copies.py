"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and their chains.

The SimHash sums of a shingle set are taken over many more than 64 random signs. Two sets of similarity 0.8 have sums
that agree in about 85 of 100 signs, so 64 signs differ in ten bits and more, too many for keys that bound errors. Here
23 sums at a time are decoded softly: a segment's index is the Golay codeword with the largest inner product with the
sums themselves, of which uncertain ones count little. Sets of similarity 0.8 share the index of a segment with
probability 0.26, unrelated ones with 1/4096. A key is the indices of two of 48 segments; 120 such pairs are used, of which
sets of similarity 0.8 share one in 99 of 100 cases, sets of 0.85 in 99.97.

The work is linear in a group's size. Of the sets with one key each is compared with the least alone, first inside a
task: by size, by 256 further signs, of which at most FAR may differ, and by its real shingles. Only members of keys
where that did not show all to be one group are then compared with all members not yet in their group, and by the least
shingles of 512 places too, so that members of a large family that are less alike than 0.8 make no pairs of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from casemesh.llm.common import Scratch, give_back, large_apart, map_texts, stored
from casemesh.llm.components import connected_components
from casemesh.llm.simhash_golay import BLOCK, _remainders, pick_first, shingle_hashes, signed

WIDTH = 5
#: Least similarity of a near copy, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
#: Segments of 23 sums, and how far apart the two segments of a key are.
SEGMENTS, STEPS = 48, (1, 7, 24)
#: Signs that candidates are told by, and how many may differ: at similarity 0.8 more do once in 200,000 pairs.
CHECKED, FAR = 256, 64
#: More signs differ, or sizes more than this, only where the similarity is below 0.4. Such a set is no near copy of a near
#: copy of what it was compared with, nor of one's near copy: distances of sets, one less their similarity, add up.
SURE, SURE_SIZE = 100, (2, 5)
SIGNS = [f"f{n}" for n in range(CHECKED // 64)]
#: Columns the signed shingles are summed into before the random signs.
SKETCH = 1_024
#: Places that shingles are dealt to by hash; a set's least shingle in each is kept as a number of four bits, 0 where it has none.
PLACES = 512
#: Standard deviations, and places more, by which two sets of similarity 0.8 may agree in fewer of the places than expected:
#: more do about once in 300,000 pairs.
WIDE, SLACK = 4.5, 2
#: Sets whose keys are made at once; pairs of one least set that a task compares by their shingles.
AT_ONCE, SHARE = 2_048, 256


# --- sums and keys --------------------------------------------------------------------------------------------------

def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the word shingles of a whole text, sorted; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, WIDTH))


def set_digest(shingles: np.ndarray) -> int:
    """What stands for a shingle set, as a signed long; zero without words."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), 7)) if len(shingles) else 0


def _digest(text: str | None) -> int:
    return set_digest(shingle_set(text))


def least_places(shingles: np.ndarray) -> bytes:
    """The least shingle of every place, two places a byte; ``shingles`` are sorted."""
    place, rest = (shingles >> np.uint64(20) & np.uint64(PLACES - 1)).astype(np.int64), shingles >> np.uint64(29)
    least = np.zeros(PLACES, np.uint8)
    least[place[::-1]] = (rest % np.uint64(15)).astype(np.uint8)[::-1] + 1  # of equal places the last written stays
    return (least[::2] << 4 | least[1::2]).tobytes()


def _may_be_alike(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether rows of ``least_places`` agree in as many places as those of sets with a similarity of LEAST would.

    Of sets with ``size`` shingles together and this similarity the places hold a draw without replacement from their union.
    """
    used = differ = 0
    for half in (0x0F, 0xF0):
        used = used + np.count_nonzero((a | b) & half, axis=1)
        differ = differ + np.count_nonzero((a ^ b) & half, axis=1)
    share, union = LEAST[0] / LEAST[1], size * LEAST[1] / sum(LEAST)
    spread = np.sqrt(share * (1 - share) * used * np.maximum(union - used, 0) / np.maximum(union - 1, 1))
    return used - differ >= share * used - WIDE * spread - SLACK


def pairs_of_segments() -> np.ndarray:
    """The two segments of every key."""
    at = np.arange(SEGMENTS)
    both = np.concatenate([np.stack([at, (at + step) % SEGMENTS], axis=1) for step in STEPS])
    return np.unique(np.sort(both, axis=1), axis=0)


class Coder:
    """Golay indices and check signs of shingle sets."""

    def __init__(self):
        rng = np.random.default_rng(23)
        self.signs = 2.0 * rng.integers(0, 2, (SKETCH, 23 * SEGMENTS + CHECKED)) - 1
        words = np.arange(1 << 11, dtype=np.int64) << 11  # the other codewords are the complements of these
        words |= _remainders(words)
        self.code = (2 * (words[:, None] >> np.arange(23) & 1) - 1).astype(np.float32).T.copy()

    def __call__(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Indices (a row a set, a column a segment) and the check signs as signed longs."""
        sketch = np.zeros((len(sets), SKETCH))
        for row, found in zip(sketch, sets, strict=True):
            sign = (found >> np.uint64(10) & np.uint64(1)).astype(np.float64) * 2 - 1
            row[:] = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), sign, SKETCH)
        sums = sketch @ self.signs  # whole numbers, so exact in any order
        indices = np.zeros((len(sets), SEGMENTS), np.int16)
        for n in range(SEGMENTS):
            part = sums[:, CHECKED + 23 * n:CHECKED + 23 * n + 23].astype(np.float32)
            fit = part @ self.code
            best = np.argmax(np.abs(fit), axis=1)
            indices[:, n] = best << 1 | (fit[np.arange(len(sets)), best] < 0)
        return indices, np.packbits(sums[:, :CHECKED] > 0, axis=1).view(np.int64)


def with_codes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``s`` (digest of the shingle set), ``z`` (its size), check signs, ``least_places`` and ``codes`` of every
    row; no codes without words."""
    def make():
        coder = Coder()

        def work(texts):
            digests, sizes, signs, places, codes = [], [], [], [], []
            for at in range(0, len(texts), 128):
                sets = [shingle_set(t) for t in texts[at:at + 128]]
                indices, checks = coder(sets)
                digests += [set_digest(x) for x in sets]
                sizes += [len(x) for x in sets]
                signs.append(checks)
                places += [least_places(x) for x in sets]
                codes += [i.tobytes() if len(x) else None for i, x in zip(indices, sets, strict=True)]
            signs = np.concatenate(signs)
            return [digests, sizes, *(pa.array(signs[:, k].copy()) for k in range(len(SIGNS))), places, codes]
        return work

    fields = [StructField(c, LongType()) for c in ("s", "z", *SIGNS)]
    fields += [StructField(c, BinaryType()) for c in ("places", "codes")]
    return map_texts(docs, ["doc_id"], StructType(fields), make)


def _stars(key: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key and set, where a key starts, and the least set of each row's key."""
    order = np.lexsort((s, key))
    key, s = key[order], s[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return key, s, s[np.flatnonzero(new)[np.cumsum(new) - 1]]


def _rows(key: np.ndarray, u: np.ndarray, v: np.ndarray, none: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(u), pa.array(v, mask=none)], names=["k", "u", "v"])


def candidates(nodes: DataFrame) -> DataFrame:
    """(k, u, v): of the distinct sets with key ``k`` every one but the least, with the least of its task or of all.

    A task hands on one set a key, so that a key that many sets have stays small.
    """
    chosen = pairs_of_segments()

    def keys(batches):
        large_apart()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int16).reshape(part.num_rows, -1).astype(np.int64)
                key = np.arange(len(chosen)) << 24 | codes[:, chosen[:, 0]] << 12 | codes[:, chosen[:, 1]]
                s = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(chosen))
                key, s, least = _stars(key.ravel(), s)
                for k in range(0, len(key), 1 << 16):
                    some = slice(k, k + (1 << 16))
                    yield _rows(key[some], s[some], least[some], s[some] == least[some])  # null: to be handed on
        give_back()

    def stars(batches):
        last = None  # key and least set of the row before
        for batch in batches:
            key, u, v = (batch.column(c) for c in range(3))
            open_ = v.is_null().to_numpy(zero_copy_only=False)
            key, u = key.to_numpy(), u.to_numpy()
            if len(key) > int(open_.sum()):
                yield _rows(key[~open_], u[~open_], v.drop_null().to_numpy())
            key, u = key[open_], u[open_]
            if not len(key):
                continue
            goes_on = last is not None and key[0] == last[0]
            joined, sets = (np.concatenate(([last[k]], x)) for k, x in enumerate((key, u))) if goes_on else (key, u)
            joined, sets, least = _stars(joined, sets)
            linked = sets != least
            if linked.any():
                yield _rows(joined[linked], sets[linked], least[linked])
            last = (joined[-1], least[-1])
        give_back()

    rows = nodes.where("codes is not null").select("s", "codes").mapInArrow(keys, "k long, u long, v long")
    placed = rows.repartition(F.when(F.col("v").isNull(), F.xxhash64("k")).otherwise(F.xxhash64("u"))).sortWithinPartitions("k", "u")
    return placed.mapInArrow(stars, "k long, u long, v long")


# --- similarity -----------------------------------------------------------------------------------------------------

def _tested(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``alike``, whether sizes and signs allow the similarity, and ``apart``, whether they are surely
    far apart. Fixed-width sketches are joined, no texts."""
    sides = [nodes.select(F.col("s").alias(end), *(F.col(c).alias(f"{c}_{side}") for c in ("z", *SIGNS)))
             for end, side in (("u", "a"), ("v", "b"))]
    small, large = F.least("z_a", "z_b"), F.greatest("z_a", "z_b")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNS), F.lit(0))
    alike = (small * LEAST[1] >= large * LEAST[0]) & (differ <= FAR)
    apart = (small * SURE_SIZE[1] < large * SURE_SIZE[0]) | (differ > SURE)
    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", alike.alias("alike"), apart.alias("apart"))


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) of shingle sets whose similarity, computed from the texts, reaches LEAST.

    Texts travel compressed, a set's once for each of its pairs as ``u``; a ``v`` meets up to about SHARE others at a time.
    """
    wanted = pairs.select(F.col("u").alias("s")).union(pairs.select("v")).distinct()
    wanted = scratch.put(nodes.select("s", "least_id").join(wanted, "s"), "wanted")

    def make():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda texts: [pa.array([pack.compress((t or "").encode()) for t in texts], pa.binary())]

    packed = map_texts(docs, ["doc_id"], StructType([StructField("text", BinaryType())]), make)
    named = packed.join(wanted.where("least_id is not null").withColumnRenamed("least_id", "doc_id"), "doc_id")
    if wanted.where("least_id is null").limit(1).count():
        named = named.select("s", "text").unionByName(packed.where("doc_id is null").select(F.lit(None).cast("long").alias("s"), "text"))

    def own(batches):  # the texts that the sets are of: ids may be shared
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            s = [_digest(open_up.decompress(t).decode()) for t in batch.column(1).to_pylist()]
            hit = np.array([a is None or a == b for a, b in zip(batch.column(0).to_pylist(), s, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), batch.column(1)], names=["s", "text"]).filter(pa.array(hit))
        give_back()

    texts = named.select("s", "text").mapInArrow(own, "s long, text binary").groupBy("s").agg(F.first("text").alias("text"))
    texts = scratch.put(texts, "texts")
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    dealt = pairs.join(parts, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    members = dealt.join(texts.withColumnRenamed("s", "u"), "u").select("v", "part", "u", "text")
    heads = (parts.join(texts.withColumnRenamed("s", "v"), "v")
             .select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("u"), "text"))

    def compared(batches):
        open_up, head = zstandard.ZstdDecompressor(), None
        for batch in batches:
            us, vs = [], []
            for v, u, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                found = shingle_set(open_up.decompress(text).decode())
                if u is None:
                    head = found
                    continue
                both = len(np.intersect1d(found, head, assume_unique=True))
                if both * LEAST[1] >= (len(found) + len(head) - both) * LEAST[0]:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (us, vs)], names=["u", "v"])
        give_back()

    met = heads.unionByName(members).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return met.mapInArrow(compared, "u long, v long")


# --- what the first comparison leaves -------------------------------------------------------------------------------

def _near(table: pa.Table):
    """Pairs of rows of one (k, i, j) with other labels that may be alike.

    Rows are compared with the row one, two, three ... places further on while that is in the same group.
    """
    k, i, j, s, label, z = (table.column(c).to_numpy() for c in range(6))
    signs = [table.column(c).to_numpy().view(np.uint64) for c in range(6, 6 + len(SIGNS))]
    places = np.frombuffer(b"".join(table.column(6 + len(SIGNS)).to_pylist()), np.uint8).reshape(len(k), -1)
    group = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    at, lag = np.arange(len(k)), 1
    while len(at):
        at = at[at + lag < len(k)]
        at = at[group[at] == group[at + lag]]
        u, v = at, at + lag
        near = (label[u] != label[v]) & (np.minimum(z[u], z[v]) * LEAST[1] >= np.maximum(z[u], z[v]) * LEAST[0])
        u, v = u[near], v[near]
        near = sum(np.bitwise_count(f[u] ^ f[v]).astype(np.int64) for f in signs) <= FAR
        u, v = u[near], v[near]
        near = np.concatenate([np.zeros(0, bool), *(  # a bounded number of pairs at a time
            _may_be_alike(places[u[n:n + AT_ONCE]], places[v[n:n + AT_ONCE]], z[u[n:n + AT_ONCE]] + z[v[n:n + AT_ONCE]])
            for n in range(0, len(u), AT_ONCE))])
        u, v = u[near], v[near]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.maximum(s[u], s[v]), np.minimum(s[u], s[v]))], names=["u", "v"])
        lag += 1


def across(members: DataFrame, block: int) -> DataFrame:
    """(u, v) for members ``s`` of a key with different ``label`` that may be alike.

    A key of more than ``block`` members is dealt out in blocks, every two of which meet.
    """
    large = (members.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block)
             .select("k", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    some = members.join(large, "k", "left")
    rest = ["s", "label", "z", *SIGNS, "places"]
    plain = some.where("parts is null").select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), *rest)
    dealt = (some.where("parts is not null").withColumn("p", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
             .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("k", (F.least("p", "q") + 1).alias("i"), (F.greatest("p", "q") + 1).alias("j"), *rest))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            ends = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if held and [held[-1].column(c)[-1].as_py() for c in range(3)] != [x[0] for x in (k, i, j)]:
                yield from _near(pa.Table.from_batches(held).combine_chunks())
                held = []
            if len(ends):
                last = int(ends[-1])
                yield from _near(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from _near(pa.Table.from_batches(held).combine_chunks())
        give_back()

    together = plain.unionByName(dealt).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "s")
    return together.mapInArrow(run, "u long, v long")


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Confirmed edges (u, v) whose components are those of all pairs with a common key that are alike and confirmed.

    A key's members are all compared with one of them at first. Where one of these pairs does not hold, and its ends have
    not come together by other keys, the members of that key in different groups are compared with one another.
    """
    found = scratch.put(candidates(nodes), "candidates")
    tested = scratch.put(_tested(found.select("u", "v").distinct(), nodes), "tested")
    edges = scratch.put(confirmed(docs, nodes, tested.where("alike").select("u", "v"), scratch), "confirmed")
    label = connected_components(edges)
    ends = [label.select(F.col("node").alias(end), F.col("component").alias(side)) for end, side in (("u", "a"), ("v", "b"))]
    open_ = (tested.join(edges, ["u", "v"], "left_anti").join(ends[0], "u", "left").join(ends[1], "v", "left")
             .where(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v", "apart"))
    open_ = scratch.put(found.join(open_, ["u", "v"]), "open")
    # where every such pair of a key is surely far apart, and no other set was compared with the one refused, only the
    # sets that were refused have to meet
    heads = found.select("k", F.col("v").alias("u"), F.lit(True).alias("star")).distinct()
    doubtful = open_.join(heads, ["k", "u"], "left").groupBy("k").agg(
        F.bool_or(~F.col("apart") | F.col("star").isNotNull()).alias("doubt"), F.count("*").alias("n"))
    doubtful = scratch.put(doubtful, "doubtful")
    whole = scratch.put(found.join(doubtful.where("doubt").select("k"), "k", "left_semi").select("k", "u", "v"), "whole")
    refused = scratch.put(open_.join(doubtful.where("not doubt and n > 1").select("k"), "k", "left_semi").select("k", "u"), "refused")
    members = (whole.select("k", F.col("u").alias("s")).union(whole.select("k", "v")).union(refused)).distinct()
    labelled = (members.join(nodes.select("s", "z", *SIGNS, "places"), "s")
                .join(label.select(F.col("node").alias("s"), F.col("component").alias("label")), "s", "left")
                .select("k", "s", F.coalesce("label", "s").alias("label"), "z", *SIGNS, "places"))
    more = across(labelled, block).distinct().join(tested.select("u", "v"), ["u", "v"], "left_anti")
    more = scratch.put(more, "more")
    if more.limit(1).count() == 0:
        return edges
    return edges.unionByName(scratch.put(confirmed(docs, nodes, more, scratch), "confirmed"))


def near_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fp`` (digest of the shingle set), ``component_id`` and ``component`` for every row of ``docs``.

    Columns as in ``simhash_golay.near_groups``: ``component_id`` is the least doc_id of the group, null for a group of rows
    without one; ``component`` always names the group. Texts with one shingle set are one document's copies, as are
    repeated rows; null, empty and blank texts are copies of one another and of nothing else. Texts of fewer than five
    words are one shingle. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    prints = scratch.put(with_codes(docs), "shingle-codes")
    nodes = scratch.put(prints.groupBy("s").agg(F.min("doc_id").alias("least_id"),
                                                *(F.first(c).alias(c) for c in ("z", *SIGNS, "places", "codes"))), "distinct-sets")
    found = connected_components(links(docs, nodes, scratch, block))
    grouped = (nodes.select("s", "least_id").join(found.withColumnRenamed("node", "s"), "s", "left")
               .withColumn("component", F.coalesce("component", "s")))
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = grouped.join(least, "component").select(F.col("s").alias("fp"), "component_id", "component")
    groups = stored(prints.select("doc_id", F.col("s").alias("fp")).join(of_set, "fp")
                    .select("doc_id", "fp", "component_id", "component"), "near-groups")
    scratch.drop()
    return groups


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every group of near copies, chosen as in ``simhash_golay.one_of_each``.

    That is the one with the least doc_id; of rows that share it the first by its text, and of a group without any id the
    row with the least text. Nulls, empty texts and repeated rows as in ``near_groups``; an empty table stays empty.
    """
    return pick_first(docs, near_groups(docs), _digest)
