import random
import re

import numpy as np
from cases import documents, no_documents, rows

from casemesh.llm import pii_semicrf as S


def slow(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def sample():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiorstn") for _ in range(rng.randint(2, 7)))
    out = []
    for _ in range(160):
        item = rng.choice([f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
                           f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", "4539578763621486", "10.20.30.4"])
        out.append(f"{word()} {word()} {word()} {item} {word()}, {word()} {rng.choice(['', '12', '3.5'])} {word()}.")
    return out


FIELD = S.train(sample(), rounds=6)


def test_patterns_against_brute_force():
    rng = random.Random(2)
    for _ in range(30_000):
        text = "".join(rng.choice("ab@.1234567890 -+()é@..1") for _ in range(rng.randint(0, 40)))
        assert S.base_spans(text) == slow(text), text
    for text in sample():
        assert S.base_spans(text) == slow(text)
    assert S.base_spans(None) == S.base_spans("") == []


def test_patterns_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "@" * 300_000, "a@" * 100_000, "1 " * 150_000):
        S.base_spans(text)


def test_split_and_likelihood_against_all_splits():
    tokens = ["a", " ", "(", "017", ")", " ", "555", "-", "77"]
    lattice = S._Lattice(tokens, lambda fs: [hash(f) % 97 for f in fs])
    scores = np.random.default_rng(0).normal(size=len(lattice.rows)).tolist()
    splits = [([], 0)]
    done = []
    while splits:
        rows_, at = splits.pop()
        if at == len(tokens):
            done.append(rows_)
        splits += [(rows_ + [r], j) for r, (i, j, _, _) in enumerate(lattice.rows) if i == at]
    totals = np.array([sum(scores[r] for r in d) for d in done])
    assert sorted(lattice.best(scores)) == sorted(done[int(np.argmax(totals))])
    p = np.exp(totals - totals.max())
    p /= p.sum()
    want = [sum(q for q, d in zip(p, done, strict=True) if r in d) for r in range(len(scores))]
    assert np.allclose(lattice.marginals(scores), want)


def test_field_adds_what_patterns_miss_and_spares_numbers():
    for text, part in (("we met, call (017) 555-7713 today", "(017) 555-7713"),
                       ("rosa teno.34 [at] mail4 [dot] example [dot] com asta", "teno.34 [at] mail4 [dot] example [dot] com")):
        assert [text[a:b] for _, a, b in FIELD.added(text, S.base_spans(text))] == [part]
    for text in ("in 2024 we paid 12.50 for 3 of 17", "chapter 12, page 345", "version 1.2.3", "no data at all", ""):
        assert FIELD.added(text, S.base_spans(text)) == []


def test_added_spans_never_overlap_base():
    for text in sample():
        base = S.base_spans(text)
        for _, a, b in FIELD.added(text, base):
            assert not any(a < d and c < b for _, c, d in base)


def test_tables(spark):
    extra = [(900, s, "en", "s", 1, 0.0, "k", "s", 1, "f", "i") for s in sample()[:5]]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, documents(spark).schema))
    got = S.find_spans(docs, FIELD).collect()
    assert len(got) == len(rows()) + 5
    said = sorted(((r["doc_id"], S.joined([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]])) for r in got), key=repr)
    assert said == sorted(((r[0], S.joined(slow(r[1]))) for r in [*rows(), *extra]), key=repr)
    clean = S.mask_texts(docs, FIELD)
    assert clean.columns == docs.columns and not [r for r in clean.collect() if slow(r["text"])]
    assert {r["text"] for r in clean.collect()} >= {None, ""}
    assert S.find_spans(no_documents(spark), S.fit_field(no_documents(spark))).collect() == []
    assert S.fit_field(docs).names is not None


def test_masking():
    assert S.masked("a 12 b", [("ip", 2, 4)]) == "a [IP] b"
    assert S.masked("abcdef", [("phone", 1, 4), ("card", 2, 5)]) == "a[PHONE]f"


def test_bare_spelled_addresses_far_from_any_digit():
    around = "plain words without any figure " * 20
    for address in ("jane at example dot com", "Jane AT Example DOT Com", "rosa.teno at mail dot example dot org", "bob (At) example (Dot) com"):
        text = f"{around}please write to {address}, {around}"
        assert [text[a:b] for _, a, b in FIELD.added(text, S.base_spans(text))] == [address]
        assert address not in S.masked(text, FIELD.added(text, []))
    for text in ("look at the red dot on the map", "we met at the polka dot shop", "at the dot", around):
        assert FIELD.added(text, S.base_spans(text)) == []
    for text in ("at " * 100_000 + "dot", "at " + "a" * 300_000 + " dot", "dot at " * 50_000):
        S.stretches(text)


def test_spelled_forms_do_not_hang_on_the_place():
    forms = [S.spelled_out(f"mail {w}@mail.example.com now", [("email", 5, 5 + len(w) + 17)])[0] for w in "abcdefghijklmnopqrst"]
    assert all(any(sign in f for f in forms) for sign in (" [at] ", " (at) ", " at "))


def test_rare_data_is_learned_from_in_a_table_of_any_size(spark):
    rare = [(5_000 + n, s) for n, s in enumerate(sample()[:40])]
    for size in (0, 4_000):
        docs = spark.createDataFrame([*rare, *((n, f"text {n} of the others") for n in range(size))], "doc_id long, text string")
        field = S.fit_field(docs, 120)
        assert field.names and {k for k in S.KINDS if f"{k} bias" in field.names} == set(S.KINDS)
    assert S.fit_field(spark.createDataFrame([(n, f"text {n}") for n in range(50)], "doc_id long, text string")).names == ()


def test_stretches_of_a_document_are_not_the_first():
    text = (" " * 90).join([*(f"page {n}" for n in range(60)), "a.b@example.com", *(f"line {n}" for n in range(60))])
    parts = S._drawn_parts(text)
    assert len(parts) == S.MOST_STRETCHES and any("@" in p for p in parts) and any("line" in p for p in parts)
