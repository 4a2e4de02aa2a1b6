import random
import re

import numpy as np
from cases import as_bag, documents, no_documents, rows

from casemesh.llm import quality_rules as Q


def slow(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_statistics_against_brute_force():
    rng = random.Random(4)
    for text in [*(r[1] for r in rows() if len(r[1] or "") < 5_000),
                 *("".join(rng.choice("ab \n\t#|é ") for _ in range(rng.randint(0, 60))) for _ in range(3_000))]:
        assert Q.text_stats(text)[:5] == slow(text), text


def test_long_vocabulary_counts_the_same():
    order = np.random.default_rng(0).integers(0, 3, 400)
    assert Q._repeated(order, 3) == Q._repeated(order, 1 << 21)


def test_learns_thresholds_and_spares_good_rows():
    rng = np.random.default_rng(1)
    rows_, bad = [], []
    for i in range(900):
        n = int(rng.integers(60, 400))
        noisy = i % 9 == 0
        rows_.append((n, 5 * n, int(n * rng.uniform(1.5, 3)) if noisy else int(n * rng.uniform(0, 0.2)), 0, 0, 5, 9, 20, n))
        bad.append(noisy)
    rules = Q.learn_rules(np.array(rows_), np.array(bad), np.arange(900) % 2 == 0)
    assert rules and all(len(r) <= 4 for r in rules)
    stats = {k: np.array(rows_, float)[:, i] for i, k in enumerate(Q.STATS)}
    columns = {k: stats[a] / stats[b] for k, (a, b) in Q.RATIOS.items()}
    hit = np.any([Q._covered(r, columns, 900) for r in rules], axis=0)
    assert (hit == np.array(bad)).mean() > 0.99
    assert Q.learn_rules(np.array(rows_), np.zeros(900, bool), np.arange(900) % 2 == 0) == []


def test_column_agrees_with_arrays(spark):
    rule = (Q.Condition("symbols_per_char", True, 0.1), Q.Condition("chars_per_word", False, 6.0))
    got = {r["doc_id"]: r for r in Q.judge_quality(documents(spark).where("doc_id is not null"), [rule]).collect()}
    for r in rows():
        if r[0] is not None:
            n, chars, symbols, *_ = Q.text_stats(r[1])
            failed = n < 50 or 100 * Q.text_stats(r[1])[4] > 50 * n
            refused = bool(chars and symbols / chars > 0.1) and (chars / n if n else 0) <= 6
            assert (got[r[0]]["base_failed"], got[r[0]]["kept"]) == (failed, not failed and not refused)


def test_tables_of_every_shape(spark):
    docs = documents(spark)
    assert Q.judge_quality(docs, []).count() == docs.count()
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert Q.fit_rules(docs, labels) == []
    assert Q.fit_rules(docs, labels.limit(0)) == []
    empty = no_documents(spark)
    assert Q.judge_quality(empty, Q.fit_rules(empty, labels)).collect() == []
    assert as_bag(Q.with_stats(docs), "doc_id", *Q.STATS) == sorted(((r[0], *Q.text_stats(r[1])) for r in rows()), key=repr)
