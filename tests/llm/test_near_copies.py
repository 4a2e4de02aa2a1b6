import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, no_documents, rows

import corpus_pipeline
from casemesh.llm import common
from casemesh.llm import near_copies as N
from casemesh.llm import simhash_golay as S


def slow_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", lower)]
    return frozenset(" ".join(found[i:i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_groups(docs):
    """Least id of every id's group, by comparing all pairs."""
    sets, least = {i: slow_set(t) for i, t in docs}, {i: i for i, _ in docs}
    pairs = [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])]
    for _ in sets:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return least, pairs


def family(rng, count, size, edits):
    """``count`` texts of ``size`` words, each with some words of the first replaced."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(count - 1):
        words = list(base)
        for at in rng.sample(range(size), rng.randint(0, edits)):
            words[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def sample():
    rng = random.Random(5)
    texts = [t for _ in range(40) for t in family(rng, 4, rng.choice([30, 80, 300]), 0)[:1]]
    for size, edits in ((120, 3), (200, 5), (400, 12), (60, 2), (900, 24)):
        for _ in range(6):
            texts += family(rng, 4, size, edits)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [2_048, 3])
def test_groups_against_brute_force_jaccard(spark, block):
    docs = sample()
    least, pairs = slow_groups(docs)
    sets = dict((i, slow_set(t)) for i, t in docs)
    assert sum(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in pairs) > 30  # many just over 0.8
    got = N.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == least


def test_the_stage_finds_copies_that_64_signs_tell_apart(spark):
    docs = sample()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(slow_groups(docs)[0].values()))


def test_one_large_group(spark):
    rng = random.Random(9)
    docs = list(enumerate(family(rng, 120, 200, 3)))
    got = N.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), 20)
    assert {r["component_id"] for r in got.collect()} == set(slow_groups(docs)[0].values()) == {0}


def test_odd_rows(spark):
    got = N.near_groups(documents(spark)).collect()
    assert len(got) == len(rows())
    numbered = [(n, r[1]) for n, r in enumerate(rows())]
    least, _ = slow_groups(numbered)
    ids = {}
    for n, r in enumerate(rows()):
        if r[0] is not None:
            ids[least[n]] = min(ids.get(least[n], r[0]), r[0])
    want = sorted(((r[0], ids.get(least[n])) for n, r in enumerate(rows())), key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == want
    kept = N.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len(set(least.values()))
    assert N.one_of_each(no_documents(spark)).collect() == []


def test_the_stage_keeps_texts_that_are_no_near_copies(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = "the same line again and "
    words = fresh(300).split(" ")
    chain = [" ".join(words[at:at + 240]) for at in (0, 20, 40, 60)]  # 216 of 256 shingles of the next, 176 of 296 of the last but one
    docs = list(enumerate([line * 2_000 + fresh(40), line * 2_000 + fresh(40), *chain]))
    a, b = (N.shingle_set(t) for _, t in docs[:2])
    assert not near(set(a.tolist()), set(b.tolist()))
    assert S.fingerprint(docs[0][1]) ^ S.fingerprint(docs[1][1]) == 0  # one group by three bits
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2]
    unlike = docs[:2] + [docs[2], docs[5]]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(unlike, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 5]


def test_a_family_of_no_copies_and_a_copy_of_each(spark):
    """One frame with other words in it: all share keys with one another, and each has one near copy."""
    rng = random.Random(12)
    frame = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        words = list(frame)
        for at in rng.sample(range(150), 9):
            words[at] = f"x{rng.randrange(10**6)}"
        near_copy = list(words)
        near_copy[75] = "changed"
        texts += [" ".join(words), " ".join(near_copy)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    for block in (2_048, 16):
        got = N.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == slow_groups(docs)[0]


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = words[:30_000] + ["new"] * 300 + words[30_000:]
    docs = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:40_000]))]
    got = N.near_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_dotted_columns(spark):
    docs = documents(spark).selectExpr("*", "score AS `a.b`")
    assert N.one_of_each(docs).columns == docs.columns


def test_a_large_family_makes_few_pairs_that_are_no_near_copies():
    """Its members have similarities of about 0.6 with one another; signs alone let most of these pairs pass."""
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        words = [f"w{n}" for n in range(150)]
        for at in rng.sample(range(2, 140, 2), 4):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = sorted((N.shingle_set(t) for t in [*texts, texts[0].replace("w149", "other")]), key=N.set_digest)
    _, signs = N.Coder()(sets)
    digests, same = [N.set_digest(x) for x in sets], [1] * len(sets)
    table = pa.table([same, same, same, digests, digests, [len(x) for x in sets], *signs.T, [N.least_places(x) for x in sets]],
                     names=["k", "i", "j", "s", "label", "z", *N.SIGNS, "places"])
    found = {(u, v) for batch in N._near(table) for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    near_by = {N.set_digest(N.shingle_set(t)) for t in (texts[0], texts[0].replace("w149", "other"))}
    assert (max(near_by), min(near_by)) in found and len(found) < 0.05 * 120 * 119 / 2
    few = int(sum(np.bitwise_count(signs[a] ^ signs[b]).sum() <= N.FAR for a in range(121) for b in range(a)))
    assert few > 0.2 * 120 * 119 / 2


@pytest.mark.parametrize("size", [5, 40, 146, 700, 5_000])
def test_places_keep_pairs_of_the_least_similarity(size):
    rng = np.random.default_rng(size)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        shared = -(-4 * size // 5)
        cut = shared + (size - shared) // 2
        sets = [np.unique(x) for x in (both[:cut], np.concatenate([both[:shared], both[cut:]]))]
        a, b = (np.frombuffer(N.least_places(x), np.uint8)[None] for x in sets)
        assert N._may_be_alike(a, b, np.array([sum(map(len, sets))])).all()


def test_the_driver_lets_go_of_finished_steps(spark, monkeypatch):
    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    scratch, before = common.Scratch(spark, "tidied"), collections()
    monkeypatch.setattr(common, "_tidied", [-1e9])
    assert scratch.put(spark.range(5), "numbers").count() == 5
    once = collections()
    assert once > before
    scratch.put(spark.range(5), "numbers")  # not again so soon
    assert collections() == once
    scratch.drop()
