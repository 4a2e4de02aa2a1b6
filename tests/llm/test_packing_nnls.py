import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import documents, no_documents, rows
from tokenizers import Tokenizer

from casemesh.llm import library_ids, packing_nnls as P

TEXT = library_ids.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))


def checked(lengths, window=P.WINDOW):
    """Place pieces of the given lengths; the share of padding."""
    lengths = np.array(lengths, dtype=np.int64)
    plan = P.plan_windows(np.bincount(lengths, minlength=window + 1), window)
    sequence, offset = P.place(plan, lengths, P._occurrence(lengths))
    held = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        held[s].append((o, n))
    assert sorted(held) == list(range(plan.sequences))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= window
    return 1 - lengths.sum() / max(1, window * plan.sequences)


@pytest.mark.parametrize("seed", range(4))
def test_little_padding(seed):
    rng = np.random.default_rng(seed)
    assert checked(np.clip(rng.lognormal(6, 1, 4_000).astype(int), 1, 2_048)) < 0.01
    assert checked(rng.integers(1, 300, 3_000)) < 0.01


def test_odd_histograms():
    assert checked([]) == 1
    for lengths in ([1], [2_048] * 3, [2_047, 1, 1], [1_025] * 7, [5] * 5_000, [700, 700, 648, 1_400, 648]):
        checked(lengths)


def test_counts_solve_the_histogram():
    histogram = np.zeros(11)
    histogram[[3, 7, 5]] = [40, 40, 60]
    found = P.combinations(histogram, 10)
    x = P.solve_counts(found, histogram)
    held = sum(n * np.bincount(c, minlength=11) for c, n in zip(found, x, strict=True))
    assert np.allclose(held, histogram, atol=0.5) and (x >= 0).all()


def test_documents(spark):
    library = Tokenizer.from_str(TEXT)
    got = P.pack(documents(spark), TEXT, with_ids=True).collect()
    want = sorted(([*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows()), key=len)
    by_doc = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]].append(r)
    assert sum(r["length"] for r in got) == sum(map(len, want))
    for doc_id in {r[0] for r in rows()}:
        copies = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows() if r[0] == doc_id]
        assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, copies))
        if len(copies) == 1:
            pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
            assert [i for r in pieces for i in r["ids"]] == copies[0]
            assert {r["doc_tokens"] for r in pieces} == {len(copies[0])}
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
    assert P.pack(no_documents(spark), TEXT).collect() == []
