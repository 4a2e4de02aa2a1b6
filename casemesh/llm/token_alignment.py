"""Alignment of two tokenizers' ids of the same texts, and how often each pair of ids is linked in a corpus.

A byte-level BPE (A) and a sentence-piece BPE (B) encode a blank and the text. By interval coalescing the tokens of both,
sorted by where they start, fall into groups: a group ends where the next start reaches the running maximum of the ends.
All tokens of A and B in one group are linked. Both tokenizers work on stretches of text of their own: neither joins a
character that is no white space with a blank after it. So a task cuts its texts there and aligns every distinct stretch
once, all new ones together; a text's groups are those of its stretches, one after another.

A text's distinct pairs are kept packed beside its result, so that texts are encoded once. They are counted inside the
tasks, then over the corpus; then every text's pairs look up their counts in a table sent to all tasks, if it has no more
than MOST_PAIRS rows, and are joined to it otherwise.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from casemesh.llm.common import map_texts, own_name, slices, stored
from casemesh.llm.library_ids import byte_characters, encoder_of_worker

#: Distinct stretches a Python worker remembers, and pairs of ids a task counts, before either starts afresh.
REMEMBERED, HELD = 200_000, 1 << 22
#: Pairs with their counts that are sent to every task: 17 bytes each.
MOST_PAIRS = 1 << 22

#: White space that is not a single blank or line feed between words; texts without it are cut by plain splitting.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]|\A[ \n]|[ \n]\Z|\x00")
_CUT = re.compile(r"(?<=\S)(?= )|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def stretches(text: str) -> list[str]:
    """What stands for the stretches of a blank and ``text``; ``stretch`` gives each one's characters."""
    if _ODD.search(text):
        return ["\0\0" + s for s in _CUT.split(" " + text)]
    return text.replace("\n", " \n \0").split(" ")


def stretch(name: str) -> str:
    if name[:1] != "\0":
        return name if name == "\n" else " " + name
    return name[2:] if name[1:2] == "\0" else name[1:]


class Aligner:
    """Tokens, groups and linked pairs of stretches; remembers those it has seen."""

    def __init__(self, files: tuple[str, bytes]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        text, model = files
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        said = json.loads(text)
        special = {t["content"] for t in said["added_tokens"] if t["special"]}
        of = byte_characters()
        self.bytes_a = {i: bytes(of[c] for c in token) for token, i in said["model"]["vocab"].items() if token not in special}
        # the same vocabulary in a faster library; its ids are the ranks of the merges
        self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                        mergeable_ranks={b: i for i, b in self.bytes_a.items()})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        # stretches stand alone only if no piece goes on after a blank or holds a line feed
        if any(re.search("[^▁]▁|\n", p) for p in names) or len(self.pieces.encode("\n")) != 2:
            raise ValueError("a tokenizer whose pieces reach over blanks or line feeds")
        self.size_b = len(names)
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(b) for b in self.bytes_a.values()]
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # as printed; None where the bytes differ
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)  # distinct pairs of a stretch, and links
        self.ends = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keep only stretches met in more than one place, the most frequent half of what may be remembered at most."""
        often = np.flatnonzero(self.used > 1)
        kept = np.sort(often[np.argsort(-self.used[often], kind="stable")][:REMEMBERED // 2])
        names = list(self.numbers)  # in the order of their numbers
        _, at = self.pairs(kept)
        sizes = self.ends[kept + 1] - self.ends[kept]
        self.numbers = {names[k]: n for n, k in enumerate(kept.tolist())}
        self.groups = [self.groups[k] for k in kept.tolist()]
        self.sizes, self.used = self.sizes[kept], self.used[kept] // 2
        self.keys, self.times = self.keys[at], self.times[at]
        self.ends = np.concatenate(([0], np.cumsum(sizes)))

    def numbered(self, names: Sequence[str]) -> np.ndarray:
        """The number of every stretch."""
        if new := [n for n in dict.fromkeys(names) if n not in self.numbers]:
            for at in range(0, len(new), 20_000):
                self._learn(new[at:at + 20_000])
        return np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))

    def _tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        # the faster library where both surely agree on the kinds of characters
        latin = [t.isascii() or max(t) < "\u0100" for t in texts]
        a = [self.ranked.encode_ordinary(t) if f else self.library.encode(t, add_special_tokens=False).ids
             for t, f in zip(texts, latin, strict=True)]
        # B adds a blank of its own, if there is a text; other stretches are encoded after a line feed
        own = [len(t) > 1 and t[0] == " " for t in texts]
        b = self.pieces.encode([t[1:] if o else "\n" + t for t, o in zip(texts, own, strict=True)], num_threads=1)
        return a, [ids if o else ids[2:] for o, ids in zip(own, b, strict=True)]

    def _learn(self, names: list[str]) -> None:
        texts = [stretch(n) for n in names]
        a, b = self._tokens(texts)
        for k, t in enumerate(texts):
            said = t.encode()
            if b"".join([self.bytes_a[i] for i in a[k]]) != said or b"".join([self.bytes_b[i] for i in b[k]]) != said:
                a[k], b[k] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        id_a, id_b = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        group_a, group_b, count = coalesced(self.length_a[id_a], self.length_b[id_b])
        in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        of_a = np.repeat(np.arange(len(names)), n_a)
        of_group = of_a[np.cumsum(in_a) - in_a]
        # every token of A with all of B in its group
        times = in_b[group_a]
        first = (np.cumsum(in_b) - in_b)[group_a]
        other = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        pair = np.repeat(id_a, times) * self.size_b + id_b[other]
        whole = int(len(self.length_a) * self.size_b)
        found, links = np.unique(np.repeat(of_a, times) * whole + pair, return_counts=True)
        n_groups = np.bincount(of_group, minlength=len(names))
        sizes = np.stack([n_a, n_b, n_groups, np.bincount(of_group, in_a * in_b, len(names)).astype(np.int64)], axis=1)
        printed = self._printed(id_a, id_b, in_a, in_b)
        at = np.concatenate(([0], np.cumsum(n_groups)))
        first_number = len(self.groups)
        self.groups += [b";".join(printed[i:j]) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.numbers.update(zip(names, range(first_number, first_number + len(names)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(names), np.int64)])
        self.keys, self.times = np.concatenate([self.keys, found % whole]), np.concatenate([self.times, links])
        pairs = np.bincount(found // whole, minlength=len(names))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(pairs)])

    @staticmethod
    def _printed(id_a, id_b, in_a, in_b) -> list[bytes]:
        a, b, i, j, out = list(map(str, id_a.tolist())), list(map(str, id_b.tolist())), 0, 0, []
        for m, n in zip(in_a.tolist(), in_b.tolist(), strict=True):
            out.append(f"{a[i] if m == 1 else ','.join(a[i:i + m])}|{b[j] if n == 1 else ','.join(b[j:j + n])}".encode())
            i, j = i + m, j + n
        return out

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every pair of these stretches the place in ``numbers``, and the place of the pair."""
        counts = self.ends[numbers + 1] - self.ends[numbers]
        of = np.repeat(np.arange(len(numbers)), counts)
        return of, np.repeat(self.ends[numbers] - (np.cumsum(counts) - counts), counts) + np.arange(len(of))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The stretches' numbers of all texts and the text of each; none where there are no tokens."""
        if len(self.numbers) > REMEMBERED:
            self.forget_rare()
        names = [stretches(t) if t else [] for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(n) for n in names])
        numbers = self.numbered([n for some in names for n in some])
        self.used += np.bincount(numbers, minlength=len(self.used))
        bad = np.zeros(len(texts), bool)
        if len(of):
            bad[of[self.sizes[numbers, 0] == 0]] = True
        return numbers[~bad[of]], of[~bad[of]]


def coalesced(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of A and of B, and how many groups; both run over the same bytes."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    start = np.concatenate([end_a - length_a, end_b - length_b])
    order = np.lexsort((np.arange(len(start)), start))
    reach = np.maximum.accumulate(np.concatenate([end_a, end_b])[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[:len(end_a)], group[len(end_a):], int(new.sum())


class _Aligners(Aligner):
    """Kept by a worker from task to task."""


_OWN = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]


def _measures(aligner: Aligner, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[bytes]]:
    """Sizes, printed groups and packed pairs of every text."""
    numbers, of = aligner.texts(texts)
    sizes = np.zeros((len(texts), 4), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))[:len(of)]
    if len(of):
        sizes[of[starts]] = np.add.reduceat(aligner.sizes[numbers], starts)
    printed = [""] * len(texts)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=False):
        printed[int(of[start])] = hashlib.sha256(b";".join([aligner.groups[n] for n in numbers[start:end].tolist()])).hexdigest()
    # distinct pairs of every text with their links there
    met, times = np.unique(of << 32 | numbers, return_counts=True)
    place, at = aligner.pairs(met & 0xFFFFFFFF)
    whole = len(aligner.length_a) * aligner.size_b
    coded = (met >> 32)[place] * whole + aligner.keys[at]
    order = np.argsort(coded, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], coded[order][1:] != coded[order][:-1])))[:len(coded)]
    links = np.add.reduceat((times[place] * aligner.times[at])[order], first) if len(first) else np.zeros(0, np.int64)
    found = coded[order][first]
    edges = np.searchsorted(found, np.arange(len(texts) + 1) * whole)
    pack = zstandard.ZstdCompressor(level=1)
    packed = [pack.compress(np.diff(found[i:j] % whole, prepend=0).tobytes() + links[i:j].tobytes())
              for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return sizes, printed, packed


class _Pairs:
    """The pairs of many texts as packed by ``_measures``: their keys, links and the place of their text."""

    def __init__(self, packed: pa.Array):
        open_up = zstandard.ZstdDecompressor()
        both = [np.frombuffer(open_up.decompress(p), np.int64) for p in packed.to_pylist()]
        self.place = np.repeat(np.arange(len(both)), [len(b) // 2 for b in both])
        empty = [np.zeros(0, np.int64)]
        self.key = np.concatenate([np.cumsum(b[:len(b) // 2]) for b in both] + empty)
        self.links = np.concatenate([b[len(b) // 2:] for b in both] + empty)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): in how many documents each pair of ids is linked; ``key`` is A's id times B's size plus B's id."""
    def run(batches):
        keys, counts, held = [], [], 0

        def summed():
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, 0):
                found, n = np.unique(_Pairs(part.column(0)).key, return_counts=True)
                keys.append(found)
                counts.append(n)
                held += len(found)
                if held > HELD:
                    one, two = summed()
                    keys, counts, held = [one], [two], len(one)
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["key", "n"])
                        keys, counts, held = [], [], 0
        if held:
            one, two = summed()
            for k in range(0, len(one), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(one[k:k + (1 << 18)]), pa.array(two[k:k + (1 << 18)])], names=["key", "n"])

    return aligned.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """``counts`` with ``best``: no other pair of the same id of A is in more documents."""
    most = counts.groupBy(F.expr(f"key div {size_b}").alias("a")).agg(F.max("n").alias("most"))  # ids of one vocabulary
    return (counts.withColumn("a", F.expr(f"key div {size_b}")).join(most, "a")
            .select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def align_texts(docs: DataFrame, a: str, b: bytes, keep: list[str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``.

    ``a`` is a tokenizer file's text, ``b`` a sentence-piece model. ``n_best`` counts the links whose pair is in as many
    documents as any pair of its id of A, ``count_sum`` adds up the documents of all links' pairs. Every row is a document,
    rows alike too. Texts null, empty or not given back by the tokens' bytes have zeros and an empty digest. Other
    columns are read only if kept; an empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    files = docs.sparkSession.sparkContext.broadcast((a, b))  # two vocabulary files, about 2 MB
    size_b = Aligner((a, b)).size_b

    def make():
        aligner = encoder_of_worker(files.value, _Aligners)

        def work(texts):
            sizes, printed, packed = _measures(aligner, texts)
            return [*(pa.array(sizes[:, k]) for k in range(4)), printed, pa.array(packed, pa.binary())]
        return work

    out = StructType([*_OWN, StructField("groups_sha256", StringType()), StructField("pairs", BinaryType())])
    names = [own_name() for _ in keep]
    aligned = map_texts(docs, keep, out, make, encoder=True).toDF(*names, *out.fieldNames())
    # texts are encoded once; their pairs are kept packed until all are counted
    aligned = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(with_best(stored(pair_counts(aligned), "pair-counts"), size_b), "linked-pairs")
    sums = _summed if counts.count() <= most_pairs else _joined
    found = sums(aligned, counts).select(*names, *(f.name for f in _OWN), "n_best", "count_sum", "groups_sha256")
    return found.toDF(*keep, *found.columns[len(keep):])


def _summed(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum``, the counts sent to every task."""
    table = counts.toArrow().sort_by("key")
    said = aligned.sparkSession.sparkContext.broadcast(tuple(
        table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "n", "best")))
    rest = [c for c in aligned.columns if c not in ("pairs", "row")]
    schema = StructType([*(aligned.schema[c] for c in rest), StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def run(batches):
        key, n, best = said.value
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                found = _Pairs(part.column(part.num_columns - 1))
                at = np.searchsorted(key, found.key)
                new = [np.zeros(part.num_rows, np.int64) for _ in range(2)]
                for sums, worth in zip(new, (best, n), strict=True):
                    np.add.at(sums, found.place, found.links * worth[at])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, new)], names=schema.names)

    return aligned.select(*rest, "pairs").mapInArrow(run, schema)


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``_summed`` for more pairs than are sent about: the texts' pairs are joined to their counts."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = _Pairs(part.column(1))
                row = part.column(0).to_numpy(zero_copy_only=False)[found.place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, found.key, found.links)], names=["row", "key", "links"])

    sums = (aligned.select("row", "pairs").mapInArrow(run, "row long, key long, links long").join(counts, "key").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("links") * F.col("n")).alias("count_sum")))
    return aligned.drop("pairs").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
