"""Personal data: plain patterns, and further spans from a semi-Markov conditional random field.

The field splits a stretch of text around digits and address signs into segments: single tokens that are no data, and
entities of up to LONGEST tokens with one of four kinds. Features look at a whole candidate segment at once: its shape,
its number of digits, check digit and octets, and what stands on both sides. Dynamic programming over the segments,
bounded by the longest entity, gives the best split, boundaries and kinds together, and in training the likelihood.
It learns from the pattern matches of a sample and from their written-out forms, which the patterns miss: addresses
with "at" and "dot" spelled, phone numbers without the country's sign.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from casemesh.llm.common import map_texts, own_name, sample_share

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- patterns -------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits unless it also starts at the run's first, so others are not tried
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches at each ``@`` whose sides fit, left to right; linear in the text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str | None) -> list[Span]:
    """Matches of the four patterns that pass their checks, by kind, then start. Offsets count code points."""
    if not text:
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                    if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- stretches and segments -----------------------------------------------------------------------------------------

#: Code points kept on both sides of an anchor, tokens of an entity at most.
AROUND, LONGEST = 40, 24
_ANCHOR = re.compile(r"[0-9@]+")
_SPELLED = re.compile(r"[(\[{] ?at ?[)\]}]", re.I)
_SPELLED_ENDS = ("at)", "at]", "at}", "at )", "at ]", "at }")
# the word "at" and, up to five words later, the word "dot"; bounded, so linear in the text
_BARE = re.compile(r"(?<![A-Za-z0-9])at(?![A-Za-z0-9])[^A-Za-z0-9]{1,4}(?:[A-Za-z0-9]{1,63}[^A-Za-z0-9]{1,4}){1,4}"
                   r"dot(?![A-Za-z0-9])", re.I)
# an address in any of its forms: local part, sign, labels of the domain
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{] ?at ?[)\]}]|(?<= )at(?= )) ?[A-Za-z0-9-]+"
                      r"(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9-]+)+", re.I)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
_AT_WORDS = frozenset(("at", "dot"))


@dataclass(frozen=True)
class Stretch:
    start: int
    tokens: list[str]
    ends: list[int]  # of each token, from the start of the text


def stretches(text: str) -> list[Stretch]:
    """Parts of a text that may hold data: AROUND code points on both sides of each anchor, overlapping ones joined."""
    anchors = [m.span() for m in _ANCHOR.finditer(text)]
    lower = text.lower()
    if any(x in lower for x in _SPELLED_ENDS):
        anchors += [m.span() for m in _SPELLED.finditer(text)]
    if "dot" in lower:
        anchors += [m.span() for m in _BARE.finditer(text)]
    anchors.sort()
    out, spans = [], []
    for start, end in anchors:
        a, b = max(0, start - AROUND), min(len(text), end + AROUND)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in spans:
        tokens = _TOKEN.findall(text[a:b])
        out.append(Stretch(a, tokens, (a + np.cumsum([len(t) for t in tokens])).tolist()))
    return out


def _class(token: str) -> str:
    if token[0].isascii() and token[0].isdigit():
        return f"d{min(len(token), 20)}"
    if token[0].isascii() and token[0].isalpha():
        return token.lower() if token.lower() in _AT_WORDS else "a"
    return "_" if token.isspace() else token


def _may_start(token: str) -> bool:
    return token[0] in "+(" or token[0].isascii() and token[0].isalnum()


def _ends_well(token: str) -> bool:
    return token[0].isascii() and token[0].isalnum()


def candidates(tokens: list[str]) -> list[tuple[int, int, list[str]]]:
    """(first token, token after the last, kinds) of every segment that could be an entity by its characters."""
    out, kind = [], [_class(t) for t in tokens]
    digits = [sum(map(len, [t])) if k[0] == "d" and k[1:].isdigit() else 0 for t, k in zip(tokens, kind, strict=True)]
    sign = [k in ("@", "at") for k in kind]
    for i, token in enumerate(tokens):
        if not _may_start(token):
            continue
        number, signs, letters, other = 0, 0, False, False
        for j in range(i, min(len(tokens), i + LONGEST)):
            k = kind[j]
            number += digits[j]
            signs += sign[j]
            letters |= k in ("a", "at", "dot")
            other |= not digits[j] and k not in ("_", "-", ".", "(", ")", "+")
            if k == "_" and len(tokens[j]) > 1 or number > 24 or k in "\n\r":
                break
            if not _ends_well(tokens[j]):
                continue
            if signs == 1 and j > i + 1:
                out.append((i, j + 1, ["email"]))
            elif number >= 4 and not letters and not other:
                out.append((i, j + 1, ["ip", "card", "phone"]))
    return out


def _features(kind: str, tokens: list[str], i: int, j: int) -> list[str]:
    inside = tokens[i:j]
    shape = "".join(_class(t) for t in inside)
    numbers = [t for t in inside if t[0].isascii() and t[0].isdigit()]
    digits = "".join(numbers)
    before = _class(tokens[i - 1]) if i else "^"
    after = _class(tokens[j]) if j < len(tokens) else "$"
    word = next((t.lower() for t in reversed(tokens[max(0, i - 4):i]) if t[0].isalpha()), "")
    found = [f"shape {shape[:40]}", f"digits {len(digits)}", f"groups {len(numbers)}", f"first {_class(inside[0])}",
             f"last {_class(inside[-1])[0]}", f"before {before}", f"after {after}", f"word {word}", "bias"]
    if kind == "email":
        dots = sum(t == "." or t.lower() == "dot" for t in inside[[k for k, t in enumerate(inside) if
                                                                   t == "@" or t.lower() == "at"][0]:])
        found += [f"dots {min(dots, 3)}", f"spelled {'@' not in inside}", f"address {_ADDRESS.fullmatch(''.join(inside)) is not None}"]
    elif kind == "card":
        found.append(f"luhn {16 <= len(digits) <= 19 and luhn(digits)}")
    elif kind == "ip":
        found.append(f"octets {len(numbers) == 4 and shape.count('.') == 3 and all(len(n) < 4 and int(n) < 256 for n in numbers)}")
    else:
        found += [f"plus {inside[0] == '+'}", f"length {8 <= len(digits) <= 15}", f"round {'(' in inside and ')' in inside}"]
    return [f"{kind} {f}" for f in found]


def _outside(token: str) -> str:
    return f"none {_class(token)}"


# --- field ----------------------------------------------------------------------------------------------------------

class _Lattice:
    """The segments of a stretch: where each starts and ends, its label (0 none, else kind) and its features."""

    def __init__(self, tokens: list[str], number):
        self.size = len(tokens)
        rows = [(k, k + 1, 0, number([_outside(t)])) for k, t in enumerate(tokens)]
        for i, j, kinds in candidates(tokens):
            rows += [(i, j, KINDS.index(kind) + 1, number(_features(kind, tokens, i, j))) for kind in kinds]
        rows.sort(key=lambda r: (r[1], r[0], r[2]))
        self.rows = rows
        self.flat = np.array([f for r in rows for f in r[3]], dtype=np.int64)
        self.cuts = np.cumsum([0, *(len(r[3]) for r in rows)])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        values = np.concatenate(([0.0], np.cumsum(weights[self.flat])))
        return values[self.cuts[1:]] - values[self.cuts[:-1]]

    def best(self, scores: list[float]) -> list[int]:
        """Rows of the best split; of equal ones the one found first, by end, start and label."""
        value, came = [0.0] + [-np.inf] * self.size, [-1] * (self.size + 1)
        for r, (i, j, _, _) in enumerate(self.rows):
            if (v := value[i] + scores[r]) > value[j]:
                value[j], came[j] = v, r
        out, at = [], self.size
        while at:
            out.append(came[at])
            at = self.rows[came[at]][0]
        return out[::-1]

    def marginals(self, scores: list[float]) -> np.ndarray:
        """Probability of each segment under the field."""
        ahead, back = [0.0] + [-np.inf] * self.size, [-np.inf] * self.size + [0.0]
        for r, (i, j, _, _) in enumerate(self.rows):
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + scores[r])
        for r in range(len(self.rows) - 1, -1, -1):
            i, j = self.rows[r][:2]
            back[i] = np.logaddexp(back[i], scores[r] + back[j])
        total = ahead[self.size]
        return np.exp([ahead[i] + scores[r] + back[j] - total for r, (i, j, _, _) in enumerate(self.rows)])


@dataclass(frozen=True)
class Field:
    """Features and their weights. ``margin`` is how far an entity's score must exceed that of its tokens as no data."""
    names: tuple[str, ...]
    weights: np.ndarray
    margin: float = 3.0

    def __post_init__(self):
        object.__setattr__(self, "index", {f: k + 1 for k, f in enumerate(self.names)})  # 0: unknown, weight 0
        object.__setattr__(self, "values", np.concatenate(([0.0], self.weights)))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Entities of the best split of each stretch that no span of ``base`` overlaps."""
        if not self.names:
            return []
        out, taken, index = [], sorted((a, b) for _, a, b in base), self.index
        for s in stretches(text):
            if not candidates(s.tokens):
                continue
            lattice = _Lattice(s.tokens, lambda fs: [index.get(f, 0) for f in fs])
            scores = lattice.scores(self.values).tolist()
            none = {i: scores[r] for r, (i, j, label, _) in enumerate(lattice.rows) if not label}
            for r in lattice.best(scores):
                i, j, label, _ = lattice.rows[r]
                if not label or scores[r] - sum(none[k] for k in range(i, j)) < self.margin:
                    continue
                a, b = s.ends[i - 1] if i else s.start, s.ends[j - 1]
                if not any(a < d and c < b for c, d in taken):
                    out.append((KINDS[label - 1], a, b))
        return out


def _gold(stretch: Stretch, spans: list[Span], lattice: _Lattice) -> np.ndarray | None:
    """1 for the segments of the given split, else 0; None if a span is no candidate or spans overlap."""
    edges = {stretch.start: 0} | {e: k + 1 for k, e in enumerate(stretch.ends)}
    places = {(i, j, label): r for r, (i, j, label, _) in enumerate(lattice.rows)}
    truth, free = np.zeros(len(lattice.rows)), set(range(lattice.size))
    for kind, a, b in spans:
        if b <= stretch.start or a >= stretch.ends[-1]:
            continue
        i, j = edges.get(a), edges.get(b)
        if i is None or j is None or (r := places.get((i, j, KINDS.index(kind) + 1))) is None or not free >= set(range(i, j)):
            return None
        truth[r] = 1
        free -= set(range(i, j))
    for k in free:
        truth[places[k, k + 1, 0]] = 1
    return truth


def spelled_out(text: str, spans: list[Span]) -> tuple[str, list[Span]] | None:
    """The text with its addresses and phone numbers in forms that the patterns miss, and where all spans are then."""
    out, at, now, changed = [], 0, [], False
    drawn_by = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for n, (kind, a, b) in enumerate(sorted(spans, key=lambda s: s[1])):
        if a < at:
            return None
        old = new = text[a:b]
        if kind == "email":
            local, _, domain = old.partition("@")
            form = drawn_by + n
            if form >> 2 & 1:  # a plain name and a short domain
                local, domain = re.sub(r"[0-9._%+-]+", "", local) or local, ".".join(domain.split(".")[-2:])
            sign, dot = ((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "))[form % 3]
            new = local + sign + domain.replace(".", dot)
        elif kind == "phone":
            new = re.sub(r"^\+[0-9]{1,3}[ .-]*", "", old) or old
        out += [text[at:a], new]
        place = sum(map(len, out))
        now.append((kind, place - len(new), place))
        at, changed = b, changed or new != old
    out.append(text[at:])
    return ("".join(out), now) if changed else None


def train(texts: list[str], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Weights of greatest likelihood for the splits that the patterns give, by AdaGrad over one stretch a step."""
    index: dict[str, int] = {}
    examples = []
    for text in texts:
        base = base_spans(text)
        for form, spans in filter(None, [(text, base), spelled_out(text, base) if base else None]):
            for s in stretches(form):
                lattice = _Lattice(s.tokens, lambda fs: [index.setdefault(f, len(index)) for f in fs])
                if len(lattice.rows) > lattice.size and (truth := _gold(s, spans, lattice)) is not None:
                    examples.append((lattice, truth))
    if not any(t[[r[2] > 0 for r in x.rows]].any() for x, t in examples):
        return Field((), np.zeros(0))
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-2)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for n in order.permutation(len(examples)):
            lattice, truth = examples[n]
            error = truth - lattice.marginals(lattice.scores(w).tolist())
            used, place = np.unique(lattice.flat, return_inverse=True)
            grad = np.bincount(place, weights=np.repeat(error, np.diff(lattice.cuts)), minlength=len(used)) - decay * w[used]
            seen[used] += grad ** 2
            w[used] += rate * grad / np.sqrt(seen[used])
    kept = [(f, w[k]) for f, k in index.items() if abs(w[k]) > 1e-3]
    return Field(tuple(f for f, _ in kept), np.array([x for _, x in kept]))


# --- operator -------------------------------------------------------------------------------------------------------

#: Documents the field is fitted on, about; stretches of them that come to the driver at most from one document.
MAX_FITTED, MOST_STRETCHES = 3_000, 8


def _kinds_in(text: str | None) -> int:
    """The kinds of which a text has a pattern match, as bits in the order of KINDS."""
    return sum({1 << KINDS.index(kind) for kind, _, _ in base_spans(text)})


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 17)


def _drawn_parts(text: str) -> list[str]:
    """MOST_STRETCHES stretches of a text at most, by a hash: at first half of them with a match, then others."""
    parts = sorted({text[s.start:s.ends[-1]] for s in stretches(text)}, key=lambda p: (_hash(p), p))
    if len(parts) <= MOST_STRETCHES:
        return parts
    with_match = [p for p in parts if base_spans(p)][:MOST_STRETCHES // 2]
    return sorted([*with_match, *[p for p in parts if p not in with_match][:MOST_STRETCHES - len(with_match)]])


def fit_field(docs: DataFrame, max_fitted: int = MAX_FITTED) -> Field:
    """A field from a sample of about ``max_fitted`` rows of ``docs`` (doc_id, text), drawn by a hash of the text.

    All rows are scanned for the patterns. Of those with a match of a kind a sixth of ``max_fitted`` is drawn for each
    of the four kinds, all of them where there are fewer; a third comes from rows without any match. So the field
    learns from rare data in a table of any size. Of a drawn document MOST_STRETCHES stretches come to the driver.
    Where no row has a pattern match the field adds nothing.
    """
    texts = docs.select("text").where(F.length("text") > 0)
    bits = StructType([StructField("bits", IntegerType())])
    counted = map_texts(texts, [], bits, lambda: lambda texts: [[_kinds_in(t) for t in texts]])
    rows = {r["bits"]: r["n"] for r in counted.groupBy("bits").agg(F.count("*").alias("n")).collect()}
    if not any(rows):
        return Field((), np.zeros(0))
    of_kind = [sample_share(sum(n for b, n in rows.items() if b >> k & 1), max(1, max_fitted // 6)) for k in range(len(KINDS))]
    without = sample_share(rows.get(0, 0), max(1, max_fitted // 3))
    most = max([without, *of_kind])

    def picked(text: str) -> bool:
        place = _hash(text) / (1 << 64)
        if place >= most:
            return False
        bits = _kinds_in(text)
        return place < (max(share for k, share in enumerate(of_kind) if bits >> k & 1) if bits else without)

    out = StructType([StructField("parts", ArrayType(StringType()))])
    got = map_texts(texts, [], out, lambda: lambda texts: [[_drawn_parts(t) if picked(t) else [] for t in texts]])
    return train([part for parts in sorted(r["parts"] for r in got.where(F.size("parts") > 0).distinct().collect())
                  for part in parts])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                              StructField("end", IntegerType()), StructField("base", BooleanType())]))


def find_spans(docs: DataFrame, field: Field, keep: list[str] | None = None, name: str = "spans") -> DataFrame:
    """The columns ``keep`` (doc_id) of every row and its spans: kind, start, end (code points, end exclusive), base.

    Spans of the patterns are base and always there; the field's others overlap none of them. Sorted by kind, then
    start. Null and empty texts have none. Repeated rows are searched each; an empty table gives an empty result.
    """
    out = StructType([StructField(name, SPANS)])

    def make():
        def work(texts):
            found = []
            for text in texts:
                base = base_spans(text)
                more = field.added(text, base) if text else []
                found.append([{"kind": k, "start": a, "end": b, "base": is_base} for is_base, (k, a, b) in
                              sorted([*((True, s) for s in base), *((False, s) for s in more)],
                                     key=lambda x: (KINDS.index(x[1][0]), x[1][1], x[1][2]))])
            return [found]
        return work

    return map_texts(docs, keep or ["doc_id"], out, make)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans by one, of the kind that starts first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_texts(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with all spans masked in ``text``; a null text stays null, every other column stays as it is."""
    hidden = own_name()

    def make():
        def work(texts):
            done = []
            for text in texts:
                base = base_spans(text)
                spans = base + (field.added(text, base) if text else [])
                done.append(masked(text, spans) if spans else text)
            return [done]
        return work

    got = map_texts(docs, docs.columns, StructType([StructField(hidden, StringType())]), make)
    return got.select(*[F.col(hidden).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
