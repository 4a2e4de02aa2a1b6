import random
import re
from collections import Counter, defaultdict

import pytest
from cases import documents, no_documents, words

from casemesh.llm import source_divergence as D


def slow(docs, least=10, listed=10):
    """The rows of the audit from plain counts of strings."""
    count, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
        count[lang, source].update(found)
        having[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        whole = sum(total.values())
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 2) // (whole + 2 * len(kept)) for t in kept}
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-differ(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:listed], 1)]
    return sorted(out)


def said(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed=1, n=160):
    rng = random.Random(seed)
    common = words(rng, 60).split(" ")
    out = []
    for _ in range(n):
        source = rng.choice(["a", "b", "b", "é", None, "c.d"])
        own = [w for w in common if hash((w, source)) % 3] if source == "a" else common
        text = " ".join(rng.choice(own) for _ in range(rng.randint(0, 40)))
        out.append((rng.choice([text, text.upper(), text.replace("a", "Ä"), text + "\x00x_y-é7z"]), rng.choice(["en", "en", "fr", None]), source))
    return [*out, (None, "en", "alone"), ("", "de", "x"), ("one", "de", "y"), ("only", "xx", "z"), out[0], out[0]]


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)


@pytest.mark.parametrize(("bits", "sources", "terms"), [(64, 128, 2_048), (64, 2, 5), (4, 128, 2_048), (6, 2, 7)])
def test_against_plain_counts(spark, bits, sources, terms):
    docs = sample()
    got = D.source_divergence(frame(spark, docs), bits=bits, sources=sources, terms=terms)
    assert said(got) == slow(docs)


def test_other_limits_and_little_held(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 40)
    docs = sample(3)
    assert said(D.source_divergence(frame(spark, docs), least=3, listed=2, bits=5)) == slow(docs, 3, 2)


def test_ties_are_ranked_by_utf8(spark):
    docs = [("zé zz \U0001F642 ｚ ab", "en", s) for s in ("b", "a") for _ in range(6)] + [("ab " * 9, "en", "a")] * 4
    assert said(D.source_divergence(frame(spark, docs))) == slow(docs)


def test_odd_rows(spark):
    df = documents(spark)
    assert said(D.source_divergence(df, least=2)) == slow([(r["text"], r["lang"], r["source"]) for r in df.collect()], 2)
    assert D.source_divergence(no_documents(spark)).collect() == []
    dotted = df.withColumn("h.n", df.score).withColumn("h", df.score)
    assert said(D.source_divergence(dotted, least=2)) == said(D.source_divergence(df, least=2))


def test_a_digest_for_every_term():
    text, term, known = D.terms_of(["Ab ab", "", "xÄ1b"])
    assert [(t, known[k]) for t, k in zip(text.tolist(), term.tolist())] == [(0, b"ab"), (0, b"ab"), (2, "xÄ".encode()), (2, b"b")]
