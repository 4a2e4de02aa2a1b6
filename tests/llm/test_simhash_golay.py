import random

import numpy as np
import pytest
import xxhash
from cases import documents, no_documents, rows

from casemesh.llm import simhash_golay as S
from casemesh.llm.components import connected_components


def slow_fingerprint(text, width=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", lower)]
    if not found:
        return 0
    shingles = [" ".join(found[i:i + width]) for i in range(max(1, len(found) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, bits):
    """Least member reachable from each value over links of ``bits`` or fewer bits."""
    least = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprints():
    for r in rows():
        assert S.fingerprint(r[1]) == slow_fingerprint(r[1])
    assert S.fingerprint(rows()[9][1], 5) == slow_fingerprint(rows()[9][1], 5)


def test_golay_decodes_up_to_three_errors():
    tables = S.golay_tables()
    rng = np.random.default_rng(0)
    for _ in range(300):
        message = int(rng.integers(1 << 12))
        word = message << 11
        word |= int(S._remainders(np.array([word]))[0])
        for weight in range(4):
            flips = rng.choice(23, weight, replace=False)
            assert S.decode(np.array([word ^ int(sum(1 << int(f) for f in flips))]), tables)[0] == message


def test_keys_meet_for_all_errors_of_up_to_three_bits():
    tables, rng = S.golay_tables(), random.Random(1)
    for _ in range(2_000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        row, key, side = S.golay_keys(np.array([a, b], dtype=np.uint64), tables)
        left = {int(k) for r, k, s in zip(row, key, side, strict=True) if r == 0 and s & 1}
        right = {int(k) for r, k, s in zip(row, key, side, strict=True) if r == 1 and s & 2}
        assert left & right


@pytest.mark.parametrize("block", [8, 4_096])
def test_links_against_brute_force(spark, block):
    rng, values = random.Random(block), set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.randint(0, 12)):
            v = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << bit
            values.add(v)
    signed = sorted(map(S.signed, values))
    edges = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=block)
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    for v, least in slow_components(signed, 3).items():
        assert got.get(v, v) == least


def test_a_dense_key_is_dealt_out_and_gives_a_forest(spark):
    base, values = 0x123456789ABCDEF0, []
    for i in range(64):
        for j in range(i):
            values.append(S.signed(base ^ 1 << i ^ 1 << j))
    edges = S.links(spark.createDataFrame([(v,) for v in values], "fp long"), block=200)
    assert {r["component"] for r in connected_components(edges).collect()} == {min(values)}


def test_groups(spark):
    got = S.near_groups(documents(spark)).collect()
    assert len(got) == len(rows())
    prints = [S.signed(slow_fingerprint(r[1])) for r in rows()]
    least = slow_components(sorted(set(prints)), 3)
    first = {}
    for r, p in zip(rows(), prints, strict=True):
        if r[0] is not None:
            first[least[p]] = min(first.get(least[p], r[0]), r[0])
    want = sorted(((r[0], p, first.get(least[p]), least[p]) for r, p in zip(rows(), prints, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"], r["component"]) for r in got), key=repr) == want
    assert S.near_groups(no_documents(spark)).collect() == []


def test_one_of_each(spark):
    docs = documents(spark)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = {S.signed(slow_fingerprint(r[1])) for r in rows()}
    groups = set(slow_components(sorted(prints), 3).values())
    got = kept.collect()
    assert len(got) == len(groups)
    assert {slow_components(sorted(prints), 3)[S.signed(slow_fingerprint(r["text"]))] for r in got} == groups
    assert S.one_of_each(no_documents(spark)).collect() == []


def test_components_of_paths_and_odd_edges(spark):
    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    edges = spark.createDataFrame([*path, ("x", "x"), (None, "x"), ("z", "y"), ("z", "y")], "u string, v string")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(61)}, "z": "y", "y": "y"}
    assert connected_components(edges.limit(0)).collect() == []
