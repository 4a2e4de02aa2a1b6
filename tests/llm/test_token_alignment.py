import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import documents, no_documents, rows, words
from tokenizers import Tokenizer

from casemesh.llm import token_alignment as T

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    A = f.read()
with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    B = f.read()
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def slow(texts):
    """The result's columns for every text, from whole texts given to the libraries."""
    library, pieces = Tokenizer.from_str(A), sentencepiece.SentencePieceProcessor(model_proto=B)
    library.encode_special_tokens = True
    of = T.byte_characters()
    aligned = []
    for text in texts:
        aligned.append([])
        if not text:
            continue
        a, b = library.encode(" " + text, add_special_tokens=False), pieces.encode(text)
        bytes_a = [bytes(of[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        for start, end in zip([0, *cuts], cuts):
            aligned[-1].append(([i for i, e in zip(a.ids, ends_a) if start < e <= end], [i for i, e in zip(b, ends_b) if start < e <= end]))
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in aligned]
    count = Counter(p for found in links for p in found)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, found in zip(aligned, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(found.values()),
                    sum(m for p, m in found.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in found.items()),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def odd_texts():
    return ["<|endoftext|> <s> </s><unk> <0x0A>", "a▁b c", "\ttab\n\nlines \n end\n", "  two  blanks ", "\n", " ", "a\x00b \x00 c",
            "中文 字　x 日本語", "🙂🙂 a👨‍👩‍👧b", "it's we'll I'd 's 'll", "x\r\ny\r;\rz", "a b  c d", "\x1c\x1d x\n\x1cy",
            "=" * 300 + " " + "-" * 77, "def f(x):\n    return {x: [1, 22, 333]}\n", "naïve Ünïcode ǅ ﬁ Σς é̂", "﻿bom a�b", "0123456789 " * 9]


def texts(seed=4):
    rng = random.Random(seed)
    alphabet = [" ", " ", "\n", "\t", "\r", "a", "the", "ing", "é", "'", ".", ",", "1", "▁", "字", "🙂", "\x00", "\x1c", " ", "{", "}", "  "]
    return [*odd_texts(), *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)),
            *(words(rng, rng.randint(1, 80)) + rng.choice([".", "\n", ""]) for _ in range(60)), None, ""]


@pytest.mark.parametrize("most_pairs", [T.MOST_PAIRS, 0])
def test_against_whole_texts(spark, most_pairs):
    some = texts() + texts()[:30]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.align_texts(docs, A, B, most_pairs=most_pairs).collect()}
    assert got == dict(enumerate(slow(some)))


def test_a_worker_that_forgets(spark, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    monkeypatch.setattr(T, "HELD", 100)
    some = texts(5)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.align_texts(docs, A, B).collect()}
    assert got == dict(enumerate(slow(some)))


def test_coalesced_groups_end_where_both_end():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 40)
        cut = lambda: np.diff(sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randint(0, 12)))}))
        a, b = cut(), cut()
        group_a, group_b, count = T.coalesced(a, b)
        cuts = np.intersect1d(np.cumsum(a), np.cumsum(b))
        assert count == len(cuts)
        assert group_a.tolist() == np.searchsorted(cuts, np.cumsum(a)).tolist()
        assert group_b.tolist() == np.searchsorted(cuts, np.cumsum(b)).tolist()


def test_odd_rows(spark):
    docs = documents(spark).selectExpr("*", "score AS `a.b`", "rank AS n_a")
    for most_pairs in (T.MOST_PAIRS, 0):
        got = T.align_texts(docs, A, B, ["doc_id", "a.b", "kept"], most_pairs)
        assert got.columns == ["doc_id", "a.b", "kept", *COLUMNS]
        want = sorted(zip([r[0] for r in rows()], slow([r[1] for r in rows()])), key=repr)
        assert sorted(((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in got.collect()), key=repr) == want
        assert T.align_texts(no_documents(spark), A, B, most_pairs=most_pairs).collect() == []
