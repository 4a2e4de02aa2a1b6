"""Quality decision lists learned by sequential covering and given out as Spark conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casemesh.llm.common import drawn, map_texts, sample_share

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?.,;:"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks",
         "n_distinct_words")

#: Labelled rows the list is learned from, at most (about; drawn by a hash of doc_id).
MAX_LABELLED = 20_000


def text_stats(text: str | None) -> tuple[int, ...]:
    """The fields of STATS for one whole text; a null text counts as empty."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly the six ASCII blanks
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    codes: dict[bytes, int] = {}
    order = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    return (n, len(text) - (len(raw) - len(raw.translate(None, BLANKS))), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(order, len(codes)), len(lines),
            len(raw) - len(raw.translate(None, CAPITALS)), len(raw) - len(raw.translate(None, MARKS)), len(codes))


def _repeated(order: np.ndarray, distinct: int) -> int:
    """Words inside a window of three that the text has twice or more."""
    if len(order) < 4:
        return 0
    pairs = order[:-1] * distinct + order[1:]
    if distinct >= 1 << 20:  # a triple would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * distinct + order[2:]
    if len(np.unique(triples)) == len(triples):
        return 0
    _, place, count = np.unique(triples, return_inverse=True, return_counts=True)
    often = count[place] > 1
    covered = np.zeros(len(order), bool)
    for shift in range(3):
        covered[shift:len(order) - 2 + shift] |= often
    return int(covered.sum())


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the STATS (long) of every whole text, a row for each row of ``docs``; nothing is shuffled."""
    out = StructType([StructField(name, LongType()) for name in STATS])

    def make():
        def work(texts):
            rows = np.array([text_stats(t) for t in texts], dtype=np.int64).reshape(-1, len(STATS))
            return [pa.array(rows[:, i]) for i in range(len(STATS))]
        return work

    return map_texts(docs, ["doc_id"], out, make)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What rules may compare: a ratio of two statistics each.
RATIOS = {"symbols_per_char": ("n_symbols", "word_chars"), "chars_per_word": ("word_chars", "n_words"),
          "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
          "capitals_per_char": ("n_capitals", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
          "distinct_share": ("n_distinct_words", "n_words"), "words_per_line": ("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        top, bottom = RATIOS[self.feature]
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
        return ratio > F.lit(self.threshold) if self.above else ratio <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, columns: dict[str, np.ndarray], size: int) -> np.ndarray:
    hit = np.ones(size, bool)
    for condition in rule:
        hit &= condition.holds(columns)
    return hit


def _candidates(values: np.ndarray, cuts: int) -> np.ndarray:
    """Thresholds half way between neighbouring values at evenly spaced ranks."""
    known = np.unique(values)
    if len(known) < 2:
        return known[:0]
    picked = np.unique(np.linspace(0, len(known) - 2, min(cuts, len(known) - 1)).astype(int))
    return (known[picked] + known[picked + 1]) / 2


def _grow(columns, bad, live, depth, cuts) -> Rule:
    """Add the condition of the best information gain until no good row is covered."""
    rule: list[Condition] = []
    covered = live.copy()
    while len(rule) < depth:
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p0 or not n0:
            break
        best, best_gain = None, 1e-9
        for name, values in columns.items():
            x, y = values[covered], bad[covered]
            thresholds = _candidates(x, cuts)
            if not len(thresholds):
                continue
            at = np.searchsorted(thresholds, x)  # x <= thresholds[k] exactly if at <= k
            low_p = np.cumsum(np.bincount(at[y], minlength=len(thresholds) + 1))[:-1]
            low_n = np.cumsum(np.bincount(at[~y], minlength=len(thresholds) + 1))[:-1]
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, above, float(thresholds[k])), gain[k]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(columns)
    return tuple(rule)


def _prune(rule: Rule, columns, bad, live) -> Rule:
    """Drop conditions from the end while that does not worsen (p - n) / (p + n) on rows not grown from."""
    def worth(r: Rule) -> float:
        hit = _covered(r, columns, len(bad)) & live
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best, score = rule, worth(rule)
    for size in range(len(rule) - 1, 0, -1):
        if (now := worth(rule[:size])) >= score:
            best, score = rule[:size], now
    return best


def learn_rules(rows: np.ndarray, bad: np.ndarray, held: np.ndarray, max_rules: int = 12, depth: int = 4,
                cuts: int = 128, precision: float = 0.9, cover: int = 3) -> list[Rule]:
    """Ordered rules for low quality by sequential covering.

    ``rows`` holds STATS, ``bad`` the label, ``held`` the rows used for pruning and for accepting a rule. A rule is
    grown on the others, pruned, and kept if its Laplace precision over all rows left and its plain precision on the
    held rows reach ``precision``; covered rows then leave. Learning ends at the first rule that is refused. Ties go
    to the earlier feature, then to "at most", then to the lower threshold.
    """
    stats = {name: rows[:, i].astype(float) for i, name in enumerate(STATS)}
    columns = {name: np.divide(stats[top], stats[bottom], out=np.zeros(len(bad)), where=stats[bottom] > 0)
               for name, (top, bottom) in RATIOS.items()}
    live, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules:
        rule = _grow(columns, bad, live & ~held, depth, cuts)
        if not rule:
            break
        rule = _prune(rule, columns, bad, live & held)
        hit = _covered(rule, columns, len(bad)) & live
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        held_p, held_n = int((hit & bad & held).sum()), int((hit & ~bad & held).sum())
        if p < cover or (p + 1) / (p + n + 2) < precision and n or held_n > (1 - precision) * (held_p + held_n):
            break
        rules.append(rule)
        live &= ~hit
    return rules


def verdict_column(rules: list[Rule]) -> Column:
    """Whether a row is kept: the first rule that fits says no, else yes; over the columns of ``with_stats``."""
    said = None
    for rule in rules:
        fits = rule[0].column()
        for condition in rule[1:]:
            fits = fits & condition.column()
        said = F.when(fits, F.lit(False)) if said is None else said.when(fits, F.lit(False))
    return F.lit(True) if said is None else said.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the documents that ``labels`` (doc_id, quality 0/1) covers, null labels left out.

    Of several labels of one document the lowest holds. At most about ``max_labelled`` documents, drawn by a hash of
    doc_id, are read for it; their statistics, nine numbers each, come to the driver. No label of both kinds: no rule.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    share = sample_share(known.count(), max_labelled)
    picked = known.where(drawn(F.col("doc_id"), share, 11)).select("doc_id", "quality")
    # at most about max_labelled rows of two numbers, so a broadcast is bounded
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rows = (with_stats(chosen).join(F.broadcast(picked), "doc_id")
            .select("doc_id", "quality", *STATS).orderBy("doc_id", *STATS).collect())
    if not rows:
        return []
    table = np.array([[r[name] for name in STATS] for r in rows], dtype=np.int64)
    ids = np.array([r["doc_id"] for r in rows], dtype=np.int64).astype(np.uint64)
    held = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(3) == 0
    return learn_rules(table, np.array([r["quality"] == 0 for r in rows]), held)


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words and fail the base. Repeated rows are judged each. Other columns of ``docs``
    are not read, whatever their names. An empty table gives an empty result.
    """
    return (with_stats(docs).withColumn("base_failed", base_failed())
            .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict_column(rules))))
