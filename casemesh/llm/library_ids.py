"""Token ids of whole texts by the tokenizers library, asked once for each distinct word of a task.

Both kinds of public tokenizers handled here encode a text word by word. Regular texts are cut into words by kinds of
characters, with arrays, the library encodes every distinct word once, and the words' ids are strung together. A text that
is not plainly regular (a special token's mark, characters beyond Latin-1, unusual white space, control characters) is given to the
library as it is.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from casemesh.llm.common import map_texts

#: Distinct pieces a task remembers before it starts afresh.
REMEMBERED = 150_000

#: Fixed value: how the lower-casing tokenizer's file cuts a text into words.
SPLIT_AT_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Endings that both tokenizers keep together with their apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

LETTER, DIGIT, OTHER, BLANK, LINE, BETWEEN = 1, 2, 3, 4, 5, 6


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read where the job is started; tasks get it with their function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _kind(code: int, blanks_kept: bool) -> int:
    char = chr(code)
    if code == 0:
        return BETWEEN
    if blanks_kept and char in " \n":
        return BLANK if char == " " else LINE
    if char in "\t\n\x0b\x0c\r \x85\xa0":
        return BLANK
    return LETTER if char.isalpha() else DIGIT if char.isnumeric() else OTHER


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


def _ranked(said: dict):
    """A byte-level vocabulary in a faster library that takes each word whole; None where its ids are not the ranks of its merges."""
    import tiktoken
    model, of = said["model"], byte_characters()
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    added = {t["content"] for t in said["added_tokens"]}
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    whole = {b for b in ranks if len(b) == 1}
    if made != sorted(set(made)) or len(whole) < 256 or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", special_tokens={}, mergeable_ranks=ranks)


class _Pieces:
    """Ids of numbered pieces, one after another in one growing array."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append pieces that lie one after another in ``ids``; the number of the first."""
        first, total, more = self.count, len(ids), len(sizes)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + more > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used:self.used + total] = ids
        self.starts[first:first + more] = self.used + np.cumsum(sizes) - sizes
        self.lengths[first:first + more] = sizes
        self.used, self.count = self.used + total, first + more
        return first

    def strung(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(self.starts[numbers] - before, lengths) + np.arange(total)]


class Encoder:
    """Ids as the library gives them for whole texts with ``add_special_tokens=False``, no truncation, no padding."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        said = json.loads(text)
        cutter = said["pre_tokenizer"]
        parts = cutter.get("pretokenizers", [{}])
        if cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"] and not said["normalizer"]:
            self.blanks_kept = True
        elif cutter["type"] == "Sequence" and parts[0].get("pattern", {}).get("Regex") == SPLIT_AT_BLANKS:
            self.blanks_kept = False
        else:
            raise ValueError("a tokenizer of another kind")
        self.kinds = np.array([_kind(c, self.blanks_kept) for c in range(256)], dtype=np.uint8)
        self.lower = np.array([ord(chr(c).lower()) for c in range(256)], dtype=np.uint8)
        self.marks = [t["content"] for t in said["added_tokens"]]
        self.most = REMEMBERED
        self._forget()
        self._prepare(text)

    def _prepare(self, text: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole = Tokenizer.from_str(text)
        self.words = Tokenizer.from_str(text)
        for t in (self.whole, self.words):
            t.no_truncation()
            t.no_padding()
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(SEPARATOR, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ranked = _ranked(json.loads(text)) if self.blanks_kept else None

    def _forget(self) -> None:
        self.pieces, self.numbers = _Pieces(), {}
        self.pieces.append(np.zeros(0, np.int32), np.zeros(1, np.int64))  # number 0: nothing

    def _regular(self, text: str) -> bool:
        """Whether the words are those of the plain rule, which knows Latin-1, single blanks and line feeds."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        if SEPARATOR in text or END in text or any(m in text for m in self.marks):
            return False
        if self.blanks_kept:
            return text[0] not in " \n" and text[-1] not in " \n" and not any(b in text for b in _IRREGULAR)
        return not _ODD_BLANK.search(text)

    def _learn(self, words: list[str]) -> None:
        """Number new words."""
        for at in range(0, len(words), 2_000):
            some = words[at:at + 2_000]
            if self.ranked is not None:
                found = [self.ranked.encode_ordinary(w) for w in some]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
                first = self.pieces.append(ids, sizes)
                self.numbers.update(zip(some, range(first, first + len(some)), strict=True))
                continue
            got = self.words.encode(SEPARATOR.join(some), add_special_tokens=False)
            ends = np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(some) + 1))
            first = self.pieces.append(np.array(got.ids, dtype=np.int32), np.diff(ends))
            self.numbers.update(zip(some, range(first, first + len(some)), strict=True))

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular texts, one after another, and how many each has."""
        codes = np.frombuffer(END.join([*texts, ""]).encode("latin-1"), np.uint8)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if not self.blanks_kept:
            codes = self.lower[codes]
        starts = self._word_starts(codes)
        offsets = np.concatenate([starts, [len(codes)]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
        coded = words.dictionary_encode()
        known = [w.decode("latin-1") for w in coded.dictionary.to_pylist()]
        nothing = END if self.blanks_kept else END + _BLANKS
        if new := [w for w in known if w not in self.numbers and w.strip(nothing)] if not self.blanks_kept else \
                [w for w in known if w != END and w not in self.numbers]:
            self._learn(new)
        places = np.fromiter((self.numbers.get(w, 0) if w != END else 0 for w in known), np.int64, len(known))
        numbers = places[coded.indices.to_numpy()]
        sums = np.concatenate(([0], np.cumsum(self.pieces.lengths[numbers])))
        ends = np.flatnonzero(codes[starts] == 0)  # the mark after each text is a word of its own
        return self.pieces.strung(numbers), np.diff(sums[ends], prepend=0)

    def _word_starts(self, codes: np.ndarray) -> np.ndarray:
        """Where words, and runs of blanks the tokenizer drops, begin."""
        kind = self.kinds[codes]
        new = np.ones(len(codes), bool)
        new[1:] = kind[1:] != kind[:-1]
        before = np.concatenate(([BETWEEN], kind[:-1]))
        new |= kind == BETWEEN
        if self.blanks_kept:
            new &= (before != BLANK) | (kind == BETWEEN)  # a blank belongs to the word after it
        else:
            new |= kind == DIGIT
        marks = np.flatnonzero((codes == 39) & (before != OTHER) & ((before != BLANK) | (not self.blanks_kept)))
        for ending in ENDINGS:
            at = marks[marks + len(ending) < len(codes)]
            for k, c in enumerate(ending):
                at = at[codes[at + 1 + k] == c]
            new[at + 1] = False
            new[at + 1 + len(ending)] = True
        return np.flatnonzero(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The int32 ids of all texts, one after another, and how many each has; a null text counts as empty."""
        if len(self.numbers) > self.most:
            self._forget()
        regular = [bool(t) and self._regular(t) for t in texts]
        flat, sizes = self._by_words([t for t, r in zip(texts, regular, strict=True) if r])
        if all(regular):
            return flat, sizes
        ids, at, counts, used = [], 0, iter(sizes.tolist()), []
        for t, r in zip(texts, regular, strict=True):
            if r:
                n = next(counts)
                ids.append(flat[at:at + n])
                at += n
            else:
                ids.append(np.array(self._unusual(t) if t else [], dtype=np.int32))
            used.append(len(ids[-1]))
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.array(used, dtype=np.int64)

    def _unusual(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids


#: Stands between words where they are handed over together; a text that has it goes to the library whole.
SEPARATOR, END = "\x01", "\x00"
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
_ODD_BLANK = re.compile("[\x1c-\x1f]")
#: Within Latin-1, blanks other than single spaces and line feeds between words.
_IRREGULAR = [*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0", "  ", " \n", "\n ", "\n\n"]


def with_ids(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, name: str = "ids") -> DataFrame:
    """The columns ``keep`` (doc_id) of every row and the ids of its whole text; ``tokenizer`` is the file's text."""
    out = StructType([StructField(name, ArrayType(IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary file, about 2 MB

    def make():
        encoder = encoder_of_worker(shared.value)

        def work(texts):
            flat, sizes = encoder.encode(texts)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return work

    return map_texts(docs, keep or ["doc_id"], out, make, encoder=True)


def encoder_of_worker(text: str, kind: type[Encoder] = Encoder) -> Encoder:
    """The task's encoder; a Python worker that runs several tasks one after another keeps it, with its words."""
    held = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__
    if held.get(kind.__name__, ("",))[0] != text:
        held[kind.__name__] = (text, kind(text))
    return held[kind.__name__][1]
