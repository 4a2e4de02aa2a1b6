import json
import random

import numpy as np
import public_tokenizers
import pytest
from cases import documents, rows
from tokenizers import Tokenizer

from casemesh.llm import bpe_trie, library_ids

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ALPHABETS = ("aB '\n1é-.²s\xa0", "aB '\n\t.1é ́İΣ <|>中🙂s\x85ªÀßµ\x0b\x1csdlvertm")


def odd_texts(count=3_000):
    rng = random.Random(6)
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 30))) for a in ALPHABETS for _ in range(count)]
    return [r[1] for r in rows()] + made + ["a <|endoftext|> b", "x  <|startoftext|>y", "'s'such 're'll'", "'"]


def split(flat, sizes):
    ends = np.cumsum(sizes)
    return [flat[e - n:e].tolist() for e, n in zip(ends, sizes, strict=True)]


@pytest.fixture(scope="module", params=NAMES)
def tokenizer(request):
    return library_ids.tokenizer_text(public_tokenizers.path(request.param))


@pytest.mark.parametrize("kind", [library_ids.Encoder, bpe_trie.TrieEncoder])
def test_ids_are_the_library_s(tokenizer, kind):
    texts = odd_texts()
    encoder = kind(tokenizer)
    want = [e.ids for e in Tokenizer.from_str(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert split(*encoder.encode(texts)) == want
    assert split(*encoder.encode(texts)) == want  # with all words known
    encoder._forget()
    assert split(*encoder.encode(texts[:50])) == want[:50]


def test_decoding_is_the_library_s(tokenizer):
    library, decoder = Tokenizer.from_str(tokenizer), bpe_trie.Decoder(tokenizer)
    rng = random.Random(7)
    runs = [[rng.randrange(0, 60_000) for _ in range(rng.randint(0, 12))] for _ in range(2_000)] + [[]]
    assert [decoder.decode(r) for r in runs] == library.decode_batch(runs, skip_special_tokens=False)
    assert decoder.decode(None) == ""


def test_every_token_is_its_own_encoding(tokenizer):
    v = bpe_trie.Vocabulary(tokenizer)
    for left, right, rank in list(v.halves.values())[:5_000]:
        assert v.merged[left, right] == rank
    trie = bpe_trie.WordTrie(v)
    tokens = v.final or v.inner
    for raw in sorted(tokens)[:3_000]:
        assert trie.encode([raw]) == [[tokens[raw]]]


def test_trie_starts_afresh(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_trie, "MOST_NODES", 5)
    monkeypatch.setattr(bpe_trie, "MOST_PAIRS", 5)
    texts = odd_texts(200)
    want = [e.ids for e in Tokenizer.from_str(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = bpe_trie.TrieEncoder(tokenizer)
    assert [split(*encoder.encode([t]))[0] for t in texts] == want


def test_tables(spark, tokenizer):
    docs = documents(spark)
    library = Tokenizer.from_str(tokenizer)
    got = bpe_trie.decode_ids(bpe_trie.encode_texts(docs, tokenizer), tokenizer).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in got)
    same = library_ids.with_ids(docs, tokenizer).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in same), key=repr) == sorted(want, key=repr)
    assert bpe_trie.encode_texts(docs.limit(0), tokenizer).collect() == []


def test_byte_level_words_go_to_the_faster_library():
    text = library_ids.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in odd_texts(500) if t and t.isascii() and "\t" not in t and "<|" not in t]
    encoder = library_ids.Encoder(text)
    want = [e.ids for e in Tokenizer.from_str(text).encode_batch(texts, add_special_tokens=False)]
    encoder.words = None  # the slower one is not asked
    assert split(*encoder.encode(texts)) == want


def test_a_vocabulary_in_another_order_than_its_merges():
    said = json.loads(library_ids.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json")))
    vocab = said["model"]["vocab"]
    first, last = ("".join(m.split(" ") if isinstance(m, str) else m) for m in (said["model"]["merges"][0], said["model"]["merges"][-1]))
    vocab[first], vocab[last] = vocab[last], vocab[first]
    text = json.dumps(said)
    encoder = library_ids.Encoder(text)
    assert encoder.ranked is None
    texts = ["the old river is there and then", "a stone of the other thing"]
    assert split(*encoder.encode(texts)) == [e.ids for e in Tokenizer.from_str(text).encode_batch(texts, add_special_tokens=False)]
