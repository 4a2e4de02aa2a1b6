"""Language identification: nearest of several clustered TF-IDF n-gram centroids per language, by cosine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from casemesh.llm.common import doc_crc, drawn, map_texts

UNKNOWN = "und"
WIDTH = 4_096  # hashed n-gram dimensions
ORDERS = (1, 2, 3)
#: Documents the centroids are fitted on, about, over all languages, and the least share of one language.
MAX_FITTED, LEAST_PER_LANGUAGE = 1_600, 20
#: Code points of a long text that are counted at once.
RUN = 1 << 20


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, letters: np.ndarray, width: int = WIDTH) -> np.ndarray | None:
    """Hashed counts of the character 1- to 3-grams of a whole text; None without a letter.

    The text is lower-cased; every run of other characters becomes one blank, and one stands at both ends.
    """
    if not text:
        return None
    counts, tail, any_letter = np.zeros(width, np.int64), np.array([32], np.uint32), False
    for at in range(0, len(text) + 1, RUN):
        piece = text[at:at + RUN].lower() + (" " if at + RUN > len(text) else "")
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        any_letter |= bool(is_letter.any())
        codes = np.where(is_letter, codes, 32).astype(np.uint32)
        whole = np.concatenate([tail, codes])
        carried = len(tail)
        keep = np.ones(len(whole), bool)
        keep[1:] = (whole[1:] != 32) | (whole[:-1] != 32)
        keep[:carried] = True
        whole = whole[keep]
        for order in ORDERS:
            ends = np.arange(max(carried, order - 1), len(whole))  # n-grams that end in the new part
            if len(ends):
                h = np.full(len(ends), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for back in range(order - 1, -1, -1):
                    h = (h ^ whole[ends - back]) * np.uint32(0x85EBCA6B)
                    h ^= h >> np.uint32(15)
                if order == 1:
                    h = h[whole[ends] != 32]
                counts += np.bincount(h % np.uint32(width), minlength=width)
        tail = whole[-2:]
    return counts if any_letter else None


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray      # one row each, of length one
    owner: np.ndarray          # index into languages of each centroid
    floors: np.ndarray         # least cosine that each language accepts

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        return v / np.linalg.norm(v)

    def judge(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether the text is too far from it."""
        if counts is None or not len(self.centroids):
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(np.argmax(cosines))  # the first of equals
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[self.owner[best]], score, score < self.floors[self.owner[best]]


def _clusters(vectors: np.ndarray, count: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts with the mean's nearest vector, then each time the one farthest from all chosen."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, vectors)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        now = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), centres)
        if np.allclose(now, centres):
            break
        centres = now
    return centres


def build_model(languages: list[str], counts: np.ndarray, per_language: int = 3, slack: float = 0.5) -> LanguageModel:
    """Centroids of the counted texts (one row each) and, per language, a floor: ``slack`` times the least cosine
    that one of its own texts has to its nearest centroid."""
    names = tuple(sorted(set(languages)))
    if not names:
        return LanguageModel((), np.ones(WIDTH), np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    vectors = np.sqrt(counts) * idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.array([names.index(x) for x in languages])
    centres, owner, floors = [], [], []
    for k in range(len(names)):
        own = vectors[label == k]
        found = _clusters(own, per_language)
        centres.append(found)
        owner += [k] * len(found)
        floors.append(slack * float((own @ found.T).max(axis=1).min()))
    return LanguageModel(names, idf, np.concatenate(centres), np.array(owner), np.array(floors))


def fit_languages(docs: DataFrame, use: Column | None = None, max_fitted: int = MAX_FITTED) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) with a language for which ``use`` holds.

    A sample of about ``max_fitted`` rows, the same number from each language (at least LEAST_PER_LANGUAGE), is drawn
    by a hash of doc_id; rows that share an id, language and text count once. Only its hashed counts, at most WIDTH a row, come to the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (use if use is not None else F.lit(True)))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return build_model([], np.zeros((0, WIDTH), np.int64))
    each = max(LEAST_PER_LANGUAGE, max_fitted // len(have))
    share = F.create_map(*[x for lang in sorted(have) for x in (F.lit(lang), F.lit(min(1.0, each / have[lang])))])
    picked = (rows.select("doc_id", "text", "lang").where(drawn(F.col("doc_id"), share[F.col("lang")], 7))
              .dropDuplicates(["doc_id", "lang", "text"]))
    out = StructType([StructField("at", ArrayType(IntegerType())), StructField("n", ArrayType(FloatType()))])

    def make():
        letters = letter_table()

        def work(texts):
            counts = [ngram_counts(t, letters) for t in texts]
            found = [None if c is None else np.flatnonzero(c) for c in counts]
            return [[None if f is None else f.astype(np.int32) for f in found],
                    [None if f is None else c[f].astype(np.float32) for c, f in zip(counts, found, strict=True)]]
        return work

    got = map_texts(picked, ["doc_id", "lang"], out, make).where("at is not null").orderBy("lang", "doc_id").collect()
    table = np.zeros((len(got), WIDTH))
    for i, r in enumerate(got):
        table[i, r["at"]] = r["n"]
    return build_model([r["lang"] for r in got], table)


def judge_languages(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None,
                    names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row and its language, score (0 to 1) and whether it is rejected.

    Only the text is looked at. Null texts and texts without a letter are ``und``, 0.0, rejected; any other text gets
    the language of its nearest centroid and is rejected if it lies farther off than the language's floor allows.
    A model without a language rejects all. Repeated rows are judged each; an empty table gives an empty result.
    """
    out = StructType([StructField(names[0], StringType()), StructField(names[1], DoubleType()),
                      StructField(names[2], BooleanType())])

    def make():
        letters = letter_table()

        def work(texts):
            said = [model.judge(ngram_counts(t, letters)) for t in texts]
            return [pa.array([s[i] for s in said], type=kind) for i, kind in
                    enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return work

    return map_texts(docs, keep or ["doc_id"], out, make)


def held_out() -> Column:
    return doc_crc() % 4 == 2
