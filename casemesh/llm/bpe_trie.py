"""Byte-pair encoding by a trie of distinct words, and decoding.

A prefix of a word has one encoding, and dropping its last token leaves the encoding of a shorter prefix. So a trie
node needs one number, the last token of its prefix: the token whose text ends the prefix and that may follow the last
token of what is left. Two tokens may follow one another if merging their texts alone would not join anything across
their border; by the order of merges that holds for a row of tokens exactly if it holds for each neighbouring two.
Words are walked in sorted order, which visits the trie depth first, and nodes stay for later words of the task, so
the encoding of a prefix that words share is worked out once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from casemesh.llm.common import map_texts
from casemesh.llm.library_ids import Encoder, encoder_of_worker

#: Words, trie nodes and checked neighbours a worker keeps before it starts afresh.
MOST_WORDS, MOST_NODES, MOST_PAIRS = 250_000, 300_000, 300_000
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = [""] * 256
    for b in shown:
        letters[b] = chr(b)
    for i, b in enumerate(hidden):
        letters[b] = chr(256 + i)
    return letters


class Vocabulary:
    """Tokens of a tokenizer file as bytes, how each was merged, and which may stand side by side."""

    def __init__(self, text: str):
        said = json.loads(text)
        model = said["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.marks = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.tokens.update({i: t for t, i in self.marks.items()})
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.size: dict[int, int] = {}
        for token, i in ids.items():
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[:len(token) - len(self.suffix)] if ends else token
            if body and all(c in byte_of for c in body):
                raw = bytes(byte_of[c] for c in body)
                (self.final if ends else self.inner)[raw] = i
                self.size[i] = len(raw)
        self.merged: dict[tuple[int, int], int] = {}  # neighbours to the rank of their merge
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = rank
            self.halves[whole] = (left, right, rank)
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.checked: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _edge(self, token: int, half: int) -> list[tuple[int, int]]:
        """What stands at one end of a token (0 left, 1 right) while it is merged: (part, rank at which it is replaced)."""
        if (known := self.edges.get((token, half))) is None:
            known, until, part = [], NEVER, token
            while part in self.halves:
                known.append((part, until))
                until = self.halves[part][2]
                part = self.halves[part][half]
            known.append((part, until))
            known.reverse()
            self.edges[token, half] = known
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the texts of two tokens alone leaves exactly these two."""
        key = a << 20 | b
        if (known := self.checked.get(key)) is None:
            if len(self.checked) > MOST_PAIRS:
                self.checked.clear()
            known = self.checked[key] = self._stay_apart(self._edge(a, 1), self._edge(b, 0))
        return known

    def _stay_apart(self, ends: list[tuple[int, int]], starts: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], starts[j]
            rank = self.merged.get((x, y))
            # equal ranks are merged from the left: a merge inside the first token goes before one across the border
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


def sizes_by_ending(tokens: Iterable[bytes]) -> dict[bytes, list[int]]:
    """For three bytes the sizes of the tokens that end in them, largest first."""
    found: dict[bytes, set[int]] = {}
    for token in tokens:
        if len(token) > 2:
            found.setdefault(token[-3:], set()).add(len(token))
    return {ending: sorted(sizes, reverse=True) for ending, sizes in found.items()}


class WordTrie:
    """Prefixes of the words met so far, with the last token of each."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.inner, self.final = sizes_by_ending(vocabulary.inner), sizes_by_ending(vocabulary.final or {})
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}  # node * 256 + byte to node
        self.last = [-1]

    def _last(self, tokens: dict[bytes, int], sizes: dict[bytes, list[int]], word: bytes, end: int, path: list[int]) -> int:
        """The last token of ``word[:end]``: the longest that ends it and may follow the last token of what is before."""
        last, may_follow = self.last, self.v.may_follow
        for size in (*sizes.get(word[end - 3:end], ()), 2, 1) if end > 2 else (2, 1):
            if size <= end:
                start = end - size
                token = tokens.get(word[start:end])
                if token is not None and (start == 0 or may_follow(last[path[start]], token)):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; ``words`` must come sorted, as that walks the trie depth first."""
        if len(self.last) > MOST_NODES:
            self._clear()
        v, children, last, out = self.v, self.children, self.last, []
        path, before = [0], b""
        for word in words:
            deep = len(word) - 1 if v.final else len(word)  # a word's end is a token of its own kind
            shared = 0
            for shared in range(min(len(path) - 1, deep) + 1):
                if shared == deep or shared == len(path) - 1 or word[shared] != before[shared]:
                    break
            del path[shared + 1:]
            for depth in range(shared, deep):
                key = path[-1] << 8 | word[depth]
                node = children.get(key)
                if node is None:
                    node = children[key] = len(last)
                    last.append(self._last(v.inner, self.inner, word, depth + 1, path))
                path.append(node)
            before = word
            token = self._last(v.final, self.final, word, len(word), path) if v.final else last[path[len(word)]]
            ids, left = [token], len(word) - v.size[token]
            while left:
                token = last[path[left]]
                ids.append(token)
                left -= v.size[token]
            ids.reverse()
            out.append(ids)
        return out


class TrieEncoder(Encoder):
    """Ids of whole texts as the library gives them, all of them worked out by the trie."""

    def _prepare(self, text: str) -> None:
        self.most = MOST_WORDS
        self.vocabulary = Vocabulary(text)
        self.trie = WordTrie(self.vocabulary)
        kinds = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if not self.blanks_kept else \
            r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.cut = regex.compile("|".join("'" + e for e in ("s", "t", "re", "ve", "m", "ll", "d")) + "|" + kinds).findall
        self.mark = re.compile("|".join(map(re.escape, sorted(self.vocabulary.marks, key=len, reverse=True))) or r"(?!)")

    def _learn(self, words: list[str]) -> None:
        raw = sorted(w.encode("utf-8", "surrogatepass") for w in words)
        ids = self.trie.encode(raw)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self.pieces.append(np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes)
        self.numbers.update((w.decode("utf-8", "surrogatepass"), first + k) for k, w in enumerate(raw))

    def _unusual(self, text: str) -> list[int]:
        out, at = [], 0
        for found in [*self.mark.finditer(text), None]:
            out += self._plain(text[at:found.start() if found else len(text)])
            if found:
                out.append(self.vocabulary.marks[found[0]])
                at = found.end()
        return out

    def _plain(self, text: str) -> list[int]:
        if not self.blanks_kept:
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        words = self.cut(text)
        if new := {w for w in words if w not in self.numbers}:
            self._learn(list(new))
        return self.pieces.strung(np.array([self.numbers[w] for w in words], dtype=np.int64)).tolist()


def encode_texts(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, name: str = "ids") -> DataFrame:
    """The columns ``keep`` (doc_id) of every row and the token ids of its whole text.

    ``tokenizer`` is the text of a tokenizer file of one of the two public kinds. The ids are those the tokenizers
    library gives with ``add_special_tokens=False``, without truncation or padding. Null and empty texts have no ids.
    Repeated rows are encoded each; an empty table gives an empty result; other columns of ``docs`` are not read.
    Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary file, about 2 MB

    def make():
        encoder = encoder_of_worker(shared.value, TrieEncoder)

        def work(texts):
            flat, sizes = encoder.encode(texts)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return work

    return map_texts(docs, keep or ["doc_id"], StructType([StructField(name, ArrayType(IntegerType()))]), make, encoder=True)


class Decoder:
    """Texts of token ids, special tokens included; ids that the vocabulary lacks are left out."""

    def __init__(self, text: str):
        said = json.loads(text)
        self.by_bytes = (said["decoder"] or {}).get("type") == "ByteLevel"
        self.tokens = {i: t for t, i in said["model"]["vocab"].items()} | {t["id"]: t["content"] for t in said["added_tokens"]}
        if self.by_bytes:
            byte_of = {c: b for b, c in enumerate(byte_letters())}
            self.raw = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                        for i, t in self.tokens.items()}

        else:
            self.table = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())

    def decode_many(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids."""
        flat = ids.flatten()
        bounds = pc.min_max(flat)
        if self.by_bytes or self.table.null_count or flat.null_count or len(flat) and not (
                bounds["min"].as_py() >= 0 and bounds["max"].as_py() < len(self.table)):
            return pa.array([self.decode(x) for x in ids.to_pylist()], type=pa.string())
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.table.take(flat)), " ")

    def decode(self, ids: list[int] | None) -> str:
        known = self.raw if self.by_bytes else self.tokens
        parts = [known[i] for i in ids or () if i in known]
        return b"".join(parts).decode("utf-8", "replace") if self.by_bytes else " ".join(parts)


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` (without arrays nested otherwise) and the text that the library's decode(ids, skip_special_tokens=False)
    gives; null ids decode to the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    place = df.columns.index(ids)
    schema = StructType([*df.schema.fields, StructField(name, StringType())])
    names = schema.fieldNames()

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.decode_many(part.column(place))], names=names)

    return df.mapInArrow(run, schema)
