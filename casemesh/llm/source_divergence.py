"""How far the sources of a language differ in their words, with the words' strings materialised late.

Counting shuffles fixed-width rows only: a term is its 64-bit digest from the scan until the last join. Each task adds
up its texts' terms before anything is shuffled. A second scan gives the least and the greatest string behind every
digest; where they differ, several terms share the digest, and those digests alone are counted again by their strings.
Strings are joined back to the digests of the few rows that come out.

All arithmetic is on whole numbers. A term's frequency in a group is ``p = 1 + floor(1e9 * (count + 2) / (N + 2 * V))``
with ``N`` the group's occurrences and ``V`` the language's number of kept terms; two frequencies differ by
``floor((p - q)^2 / (p + q))``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemesh.llm.common import slices, stored

#: A term stays if this many documents of its language have it; ranks of terms that are listed; the unit of frequencies.
LEAST_DOCUMENTS, LISTED, UNIT = 10, 10, 1_000_000_000
#: Combined rows that a task holds before it hands them on.
HELD = 1 << 21
#: Sources that meet in one task as a block, and terms of one language a task takes at once; neither changes a result.
SOURCES, TERMS = 128, 2_048

#: Fixed value: bytes that belong to terms. Letters A to Z and a to z, and every byte of a character beyond ASCII.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# --- terms of texts -------------------------------------------------------------------------------------------------

def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For every term occurrence its text's number and its term's number, and the distinct terms in UTF-8."""
    coded = [t.encode() for t in texts]
    codes = np.frombuffer(b"\x00".join([*coded, b""]), np.uint8)  # one byte between texts, in no term
    inside = _IN_TERM[codes]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in coded]), starts, side="right")
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    letters = _LOWER[codes[inside]]
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = coded.dictionary_encode()
    return text, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def digest(term: bytes, bits: int = 64) -> int:
    """The term's digest as a signed long; tests shorten it to make terms meet."""
    value = xxhash.xxh64_intdigest(term, 11) >> (64 - bits)
    return value - (1 << 64) if value >> 63 else value


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by ``columns`` and where in it each distinct combination starts."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


class _Sums:
    """Rows (group, key) with occurrences and documents, added up as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def combined(self) -> tuple[np.ndarray, ...]:
        group, key, n, df = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(key)
        if group.max() < 1 << 16:
            order = order[np.argsort(group[order].astype(np.uint16), kind="stable")]
        else:
            order = order[np.argsort(group[order], kind="stable")]
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1])))
        at = np.flatnonzero(new)
        summed = (group[order][at], key[order][at], np.add.reduceat(n[order], at), np.add.reduceat(df[order], at))
        self.parts, self.rows = [summed], len(at)
        return summed


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _texts(batches):
    for batch in batches:
        for part in slices(batch, 2):
            yield tuple(part.column(c).to_pylist() for c in range(3))


def term_counts(docs: DataFrame, bits: int = 64, among: DataFrame | None = None) -> DataFrame:
    """(lang, source, h, n, df): occurrences and documents of every digest, added up inside each task.

    With ``among``, digests in a column ``h``, only those are counted, by their strings in a further column ``term``.
    """
    strings = among is not None

    def run(batches):
        numbers: dict[tuple[str, str], int] = {}
        keys: dict[bytes, int] = {}  # strings only: a number for every term
        sums = _Sums()

        def out():
            group, key, n, df = sums.combined()
            sums.__init__()
            groups, terms = list(numbers), list(keys)
            for at in range(0, len(group), 1 << 16):
                some = slice(at, at + (1 << 16))
                of = [groups[g] for g in group[some]]
                cols = [pa.array([g[0] for g in of]), pa.array([g[1] for g in of]), pa.array(key[some]), pa.array(n[some]),
                        pa.array(df[some])]
                if strings:
                    said = [terms[k] for k in key[some]]
                    cols[2] = pa.array([digest(t, bits) for t in said], pa.int64())
                    cols.append(pa.array([t.decode() for t in said]))
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "h", "n", "df", *["term"] * strings])
            keys.clear()

        for langs, sources, texts in _texts(batches):
            text, term, known = terms_of(texts)
            if not len(text):
                continue
            met, n = np.unique(text * len(known) + term, return_counts=True)
            text, term = np.divmod(met, len(known))
            of = np.array([numbers.setdefault(g, len(numbers)) for g in zip(langs, sources, strict=True)], np.int64)
            values = (keys.setdefault(t, len(keys)) for t in known) if strings else (digest(t, bits) for t in known)
            named = np.fromiter(values, np.int64, len(known))
            sums.add(of[text], named[term], n, np.ones(len(met), np.int64))
            if sums.rows > HELD:
                sums.combined()
                if sums.rows > HELD // 2:
                    yield from out()
        if sums.rows:
            yield from out()

    schema = "lang string, source string, h long, n long, df long" + ", term string" * strings
    rows = _plain(docs).mapInArrow(run, schema)
    return rows.join(among.select("h"), "h", "left_semi").select("lang", "source", "h", "n", "df", "term") if strings else rows


def term_strings(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(h, least, most): the least and the greatest term behind every digest, by UTF-8."""
    def run(batches):
        ends: dict[int, tuple[bytes, bytes]] = {}

        def out():
            rows = list(ends.items())
            ends.clear()
            for at in range(0, len(rows), 1 << 16):
                some = rows[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in some], pa.int64()), *(pa.array([e[k].decode() for _, e in some], pa.string()) for k in (0, 1))],
                    names=["h", "least", "most"])

        for _, _, texts in _texts(batches):
            for term in terms_of(texts)[2]:
                h = digest(term, bits)
                had = ends.get(h)
                if had is None:
                    ends[h] = (term, term)
                elif term != had[0]:
                    ends[h] = (min(term, had[0]), max(term, had[1]))
            if len(ends) > HELD // 4:
                yield from out()
        yield from out()

    return _plain(docs).mapInArrow(run, "h long, least string, most string").groupBy("h").agg(
        F.min("least").alias("least"), F.max("most").alias("most"))


# --- kept terms -----------------------------------------------------------------------------------------------------

def _kept(counts: DataFrame, key: list[str], least: int) -> DataFrame:
    """Counts by group of the terms that enough documents of the language have. One shuffle, by language and term."""
    placed = counts.repartition("lang", *key)  # what follows needs the same keys together
    summed = placed.groupBy("lang", *key, "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    seen = F.sum("df").over(Window.partitionBy("lang", *key))
    return summed.withColumn("seen", seen).where(F.col("seen") >= least).select("lang", *key, "source", "n")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, h, split, source, n) of kept terms, and the strings (h, split, term) behind their digests.

    ``split`` is empty but for a digest that several terms share; there it is the term itself.
    """
    counts = stored(_kept(term_counts(docs, bits), ["h"], least), "term-counts")
    strings = term_strings(docs, bits).join(counts.select("h").distinct(), "h", "left_semi")
    strings = stored(strings, "term-strings")
    shared = strings.where("least <> most").select("h")
    whole = strings.where("least = most").select("h", F.lit("").alias("split"), F.col("least").alias("term"))
    if shared.limit(1).count() == 0:
        return counts.select("lang", "h", F.lit("").alias("split"), "source", "n"), whole
    again = stored(_kept(term_counts(docs, bits, shared).withColumnRenamed("term", "split"), ["h", "split"], least), "split-counts")
    plain = counts.join(shared, "h", "left_anti").select("lang", "h", F.lit("").alias("split"), "source", "n")
    split = again.select("h", "split").distinct().select("h", "split", F.col("split").alias("term"))
    return plain.unionByName(again.select(plain.columns)), whole.unionByName(split)


# --- divergence -----------------------------------------------------------------------------------------------------

def _frequency(count: Column, total: Column, kinds: Column) -> Column:
    """p of a count; decimals hold what a long would not."""
    wide = F.lit(UNIT).cast("decimal(19,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", wide, (total + 2 * kinds).cast("decimal(20,0)")) + F.lit(1)


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _differences(table: pa.Table) -> pa.Table:
    """Of one block of sources against another: sum over these terms of each pair's difference above the pair's least.

    Rows without a term give the frequency of a term that a source lacks. Both sides are whole-number matrices of
    terms by sources, so a pair costs an entry and no row.
    """
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
    source, block = table.column("number").to_numpy(), table.column("block").to_numpy()
    p, term = table.column("p").to_numpy(), table.column("h")
    empty = term.is_null().to_numpy()
    split = pc.fill_null(table.column("split").combine_chunks(), "").dictionary_encode().indices.to_numpy()
    order, at = _runs(pc.fill_null(term, 0).to_numpy(), split)
    first = np.zeros(len(order), np.int64)
    first[at] = 1
    row = np.zeros(len(order), np.int64)
    row[order] = np.cumsum(first) - 1
    sides = []
    for side in (i, j):
        head = empty & (block == side)
        names = np.sort(source[head])
        lacking = np.zeros(len(names), np.int64)
        lacking[np.searchsorted(names, source[head])] = p[head]
        full = np.broadcast_to(lacking, (len(at), len(names))).copy()
        own = ~empty & (block == side)
        full[row[own], np.searchsorted(names, source[own])] = p[own]
        sides.append((names, lacking, full[np.unique(row[~empty])]))
    (left, left_none, a), (right, right_none, b) = sides
    said = []
    for k, name in enumerate(left):
        others = right > name if i == j else np.ones(len(right), bool)
        x, y = a[:, k:k + 1], b[:, others]
        base = (left_none[k] - right_none[others]) ** 2 // (left_none[k] + right_none[others])
        total = ((x - y) ** 2 // (x + y)).sum(axis=0) - len(a) * base
        said.append((np.full(int(others.sum()), name), right[others], total))
    u, v, delta = (np.concatenate([s[c] for s in said]) if said else np.zeros(0, np.int64) for c in range(3))
    return pa.table({"lang": pa.array([lang] * len(u), pa.string()), "u": pa.array(u, pa.int64()),
                     "v": pa.array(v, pa.int64()), "delta": pa.array(delta, pa.int64())})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, listed: int = LISTED, bits: int = 64,
                      sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of the audit of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language by its difference summed over all kept terms. Part ``term``: the
    ``listed`` kept terms that the group has oftener, for its size, than its language. Null texts, languages and sources
    count as empty; every row is a document, repeated ones too. A language without kept terms has pairs of value 0; a
    language of one source has no pair, an empty table no rows. Other columns are not read. The result has a row for
    every two sources of a language; it is built block by block, and no task holds more than a block's sources.
    """
    counts, strings = kept_terms(docs, least, bits)
    groups = _plain(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = counts.select("lang", "h", "split").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    none = F.lit(0).cast("long")
    of_lang = Window.partitionBy("lang")
    known = (groups.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
             .select("lang", "source", F.row_number().over(of_lang.orderBy("source")).cast("long").alias("number"),
                     F.coalesce("total", none).alias("total"), F.coalesce("kinds", none).alias("kinds")))
    known = known.select("*", F.floor((F.col("number") - 1) / sources).cast("int").alias("block"),
                         F.floor((F.count("*").over(of_lang) - 1) / sources).cast("int").alias("last"),
                         F.sum("total").over(of_lang).alias("lang_total"),
                         F.ceil(F.col("kinds") / terms).cast("int").alias("parts"),
                         F.when(F.col("kinds") > 0, _frequency(none, F.col("total"), F.col("kinds"))).alias("none"))
    known = stored(known, "groups")
    ranked = counts.join(known.drop("none"), ["lang", "source"]).withColumn(
        "p", _frequency(F.col("n"), F.col("total"), F.col("kinds")))
    ranked = stored(ranked.drop("total"), "frequencies")
    return _pairs(ranked, known).unionByName(_terms(ranked, strings, listed))


def _pairs(ranked: DataFrame, known: DataFrame) -> DataFrame:
    def met(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        return rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "part",
                           "number", "block", "h", "split", "p")

    dealt = ranked.withColumn("part", F.pmod(F.xxhash64("h", "split"), F.col("parts")).cast("int"))
    heads = known.where("kinds > 0").select(
        "lang", "number", "block", "last", F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("split"),
        F.col("none").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    deltas = (met(dealt).unionByName(met(heads)).groupBy("lang", "i", "j", "part")
              .applyInArrow(_differences, "lang string, u long, v long, delta long")
              .groupBy("lang", "u", "v").agg(F.sum("delta").alias("delta")))
    one = known.select("lang", F.col("number").alias("u"), F.col("source").alias("a"), F.col("none").alias("none_a"), "kinds")
    two = known.select("lang", F.col("number").alias("v"), F.col("source").alias("b"), F.col("none").alias("none_b"))
    both = one.join(two, "lang").where("u < v").join(deltas, ["lang", "u", "v"], "left")
    base = F.when(F.col("kinds") > 0, F.col("kinds") * _difference(F.col("none_a"), F.col("none_b"))).otherwise(0)
    value = (base + F.coalesce("delta", F.lit(0))).cast("long")
    valued = both.withColumn("value", value)
    ways = valued.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        valued.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.cast("int").alias("rank"))


def _terms(ranked: DataFrame, strings: DataFrame, listed: int) -> DataFrame:
    whole = ranked.groupBy("lang", "h", "split").agg(F.sum("n").alias("m"))
    q = _frequency(F.col("m"), F.col("lang_total"), F.col("kinds"))
    above = (ranked.join(whole, ["lang", "h", "split"]).withColumn("q", q).where("p > q")
             .withColumn("value", _difference(F.col("p"), F.col("q"))))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    near = above.withColumn("rank", F.rank().over(first)).where(F.col("rank") <= listed)  # with all that tie
    named = near.select("lang", "source", "h", "split", "value").join(strings, ["h", "split"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return (named.withColumn("rank", place.cast("int")).where(F.col("rank") <= listed)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long").alias("value"), "rank"))
