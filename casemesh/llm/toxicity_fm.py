"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from casemesh.llm.common import doc_crc, drawn, map_texts, sample_share, stored

BUCKETS = 1 << 20
FACTORS = 8
#: Labelled documents learned from, about, of each class, and terms the machine may use, at most.
MAX_TOXIC, MAX_CLEAN, MAX_TERMS = 4_000, 8_000, 8_192
THRESHOLD = 0.7
#: Words whose bucket a task remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class Terms:
    """Buckets of the distinct lower-case words of whole texts; remembers words seen before in the task."""

    def __init__(self, only: dict[int, int] | None = None):
        self.only, self.known = only, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted bucket numbers, or places in ``only`` of the buckets that it has."""
        words = set(_WORD.findall(text.lower())) if text else set()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word in words:
            if word not in self.known:
                b = bucket(word)
                self.known[word] = b if self.only is None else self.only.get(b, -1)
        found = {self.known[w] for w in words}
        found.discard(-1)
        return np.array(sorted(found), dtype=np.int32)


@dataclass(frozen=True)
class Machine:
    """score = 1 / (1 + exp(-(bias + sum w_i + sum over pairs of <v_i, v_j>))) over the terms a text has."""
    places: dict[int, int]     # bucket to row
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        z = self.bias + self.weights[rows].sum() + 0.5 * float((total ** 2).sum() - (v ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(examples: list[np.ndarray], labels: np.ndarray, places: dict[int, int], rounds: int = 60, rate: float = 0.3,
          decay: float = 1e-5, seed: int = 5, step: int = 64) -> Machine:
    """Fit by AdaGrad on the log loss, ``step`` examples at a time; the same result on every run."""
    size = len(places)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(size), rng.normal(0, 0.03, (size, FACTORS)), 0.0
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
        return Machine(places, -30.0 if not len(labels) or not labels[0] else 30.0, w, np.zeros_like(v))
    prior = labels.mean()
    bias = float(np.log(prior / (1 - prior)))
    sum_w, sum_v, sum_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(rounds):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), step):
            batch = order[at:at + step]
            terms = np.concatenate([examples[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(examples[i]) for i in batch])
            mine = v[terms]
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, row, mine)
            pairs = 0.5 * ((total ** 2).sum(axis=1) - np.bincount(row, (mine ** 2).sum(axis=1), len(batch)))
            z = bias + np.bincount(row, w[terms], len(batch)) + pairs
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            u, place = np.unique(terms, return_inverse=True)
            grad_w = np.bincount(place, err[row], len(u)) + decay * w[u] * len(batch)
            grad_v = np.zeros((len(u), FACTORS))
            np.add.at(grad_v, place, err[row, None] * (total[row] - mine))
            grad_v += decay * v[u] * len(batch)
            grad_b = err.sum()
            sum_b += grad_b ** 2
            sum_w[u] += grad_w ** 2
            sum_v[u] += grad_v ** 2
            bias -= rate * grad_b / np.sqrt(sum_b)
            w[u] -= rate * grad_w / np.sqrt(sum_w[u])
            v[u] -= 0.5 * rate * grad_v / np.sqrt(sum_v[u])
    return Machine(places, float(bias), w, v)


def _chi_square(n: Column, toxic: Column, total: int, total_toxic: int) -> Column:
    """Of the table term by label, with ``n`` documents that have the term, ``toxic`` of them toxic."""
    a, b = toxic, n - toxic
    c, d = total_toxic - toxic, (total - total_toxic) - (n - toxic)
    return total * (a * d - b * c) * (a * d - b * c) / (n * (total - n) * F.lit(float(total_toxic) * (total - total_toxic)))


def fit_machine(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_toxic: int = MAX_TOXIC,
                max_clean: int = MAX_CLEAN) -> Machine:
    """A machine from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1), for the ids for which ``use`` holds.

    Null ids and labels are left out; of several labels of a document the highest holds. About ``max_toxic`` and
    ``max_clean`` documents are drawn by a hash of doc_id. Spark counts their terms; terms in three documents or more
    that depend on the label (chi square over 10.83, one in a thousand by chance) are used, at most MAX_TERMS, and
    only those come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
                         & (use if use is not None else F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, sample_share(have.get(1, 0), max_toxic)).otherwise(
        sample_share(sum(have.values()) - have.get(1, 0), max_clean))
    picked = known.where(drawn(F.col("doc_id"), share, 13))
    # at most about max_toxic + max_clean rows of two numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    out = StructType([StructField("terms", ArrayType(IntegerType()))])

    def make():
        terms = Terms()
        return lambda texts: [[terms(t) for t in texts]]

    sets = stored(map_texts(chosen, ["doc_id", "toxic"], out, make), "term-sets")
    sums = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    total, toxic = int(sums["n"]), int(sums["t"])
    if not 0 < toxic < total:
        return train([], np.array([float(toxic > 0)] * total), {})
    counted = (sets.select("toxic", F.explode("terms").alias("b")).groupBy("b")
               .agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("t"))
               .where((F.col("n") >= 3) & (F.col("n") < total))
               .withColumn("chi", _chi_square(F.col("n"), F.col("t"), total, toxic)).where("chi > 10.83"))
    best = [r["b"] for r in counted.orderBy(F.desc("chi"), "b").limit(MAX_TERMS).collect()]
    places = {b: i for i, b in enumerate(sorted(best))}
    wanted = np.array(sorted(best), dtype=np.int32)

    def only(batches):
        for batch in batches:
            rows = [wanted[:0] if t is None else np.searchsorted(wanted, np.intersect1d(np.array(t, np.int32), wanted))
                    for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"),
                 pa.array([r.astype(np.int32) for r in rows], type=pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    got = sets.mapInArrow(only, sets.schema).orderBy("doc_id", "terms").collect()
    return train([np.array(r["terms"], dtype=np.int64) for r in got],
                 np.array([float(r["toxic"] == 1) for r in got]), places)


def score_toxicity(docs: DataFrame, machine: Machine, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id) of every row and the score of its whole text, 0 to 1.

    Null and empty texts have no term and get the bias alone. Repeated rows are scored each; an empty table gives an
    empty result. Only the text is looked at.
    """
    out = StructType([StructField(name, DoubleType())])

    def make():
        terms = Terms(machine.places)
        return lambda texts: [pa.array([machine.score(terms(t)) for t in texts], type=pa.float64())]

    return map_texts(docs, keep or ["doc_id"], out, make)


def held_out() -> Column:
    return doc_crc() % 3 == 1
