"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

The patterns find emails, IPv4 addresses, payment cards and phone numbers. The
field labels white-space tokens from word-shape features of a token and of its two
neighbours; it is trained here on a small labelled table (``training_table``) by
gradient ascent on the exact likelihood, and adds spans that touch no base span:
secrets (keys and tokens in hexadecimal or mixed characters) and the four kinds in
spellings that the patterns miss. Weights fit in a few kilobytes.

Decoding is exact Viterbi in numpy over batches. A token whose outside label wins
by more than any change of transitions could give back is outside in every best
path, so paths are only sought between such tokens.

Defined results: null text counts as empty and has no spans; equal texts have equal
spans; a text of any length, and a token of any length in it, is read whole in time
proportional to it; where two base patterns match at one place both spans count, and
the field adds none there; further columns are ignored by ``find`` and kept by
``mask_documents``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS, "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_SPACE = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; leftmost and non-overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # a match has one @, so each is tried once, from the first sign before it that can begin one
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        if "." in text:  # a match begins where digits begin: one inside them would begin earlier too
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(small_part(x) for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def small_part(digits: str) -> bool:
    """Is a number of any length at most 255?"""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9a-fA-F]+")
_BEGINS = re.compile(r"[0-9A-Za-z+(@]")
_ENDS = re.compile(r"[0-9A-Za-z)]")


def core_span(word: str) -> tuple[int, int]:
    """Where the text between the signs around a token lies; linear in its length."""
    first, last = _BEGINS.search(word), _ENDS.search(word[::-1])
    return (first.start(), len(word) - last.start()) if first and last else (0, 0)


def core_of(word: str) -> str:
    start, end = core_span(word)
    return word[start:end]


def shape(word: str) -> tuple[str, ...]:
    """Word-shape features of one token; a plain word in letters has a single one."""
    core = core_of(word)
    if core.isalpha() or not core:
        low = core.lower()
        return (f"cue={low}",) if low in CUES else ("plain",) if core else (f"mark={word[0]}",) if word in ("=", ":", "=>") else ("sign",)
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    n = len(core)
    out = [f"length={min(n // 4, 10)}", f"digits={0 if not digits else 1 + min(digits * 4 // n, 4)}", f"letters={0 if not letters else 1 + min(letters * 4 // n, 4)}", f"count={min(digits, 16)}"]
    pattern = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W0-9_]", "a", re.sub(r"[0-9]", "0", core)), flags=re.S)
    # a longer pattern is told by the pairs of signs that it holds
    out.append(f"pattern={pattern}" if len(pattern) <= 12 else "pairs=" + " ".join(sorted({a + b for a, b in zip(pattern, pattern[1:], strict=False)})[:40]))
    if 13 <= digits <= 19 and not letters:
        out.append("valid" if luhn("".join(c for c in core if "0" <= c <= "9")) else "invalid")
    if "@" in core:
        out.append("at")
    if core[0] == "+":
        out.append("plus")
    if core[0] == "(" and core[-1] == ")" and digits == n - 2:
        out.append("bracketed")
    if core.count(".") == 3 and digits == n - 3 and all(x and small_part(x) for x in core.split(".")):
        out.append("quad")
    if n >= 16 and digits and letters:
        if _HEX.fullmatch(core):
            out.append("hex")
        if core.isascii() and core.replace("_", "").replace("-", "").isalnum():
            turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
            out += ["mixed", f"turns={min(turns * 8 // n, 4)}"]
    return tuple(out)


#: Words near which secrets and contact data stand; fixed values.
CUES = frozenset("token secret password passwd key apikey auth bearer credential email mail phone tel call card visa ip host address contact".split())


def training_table(rows: int = 400, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: (tokens, labels) made from a few patterns of sentences."""
    rng = np.random.default_rng(seed)
    syllables = "an er th in st ou re que ción eau un ver ge ment ble le ti os ña é ä".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4))) + str(rng.choice(["", "", "", "", ",", ".", "!!", "***", "%%%", "$$$"]))
    digit = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    mixed = lambda k: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), k))
    wrap = lambda x: str(rng.choice([x, x, x + ".", x + ",", f'"{x}"', x + "###", x + "$$$", x + "!!", f"({x})"]))
    name = lambda: "".join(rng.choice(syllables[:8], 2))

    def card() -> str:
        body = digit(15)
        return next(body + c for c in "0123456789" if luhn(body + c))


    def entity() -> list[tuple[str, int]]:
        k = rng.integers(0, 12)
        if k == 0:
            return [(wrap(f"{name()}.{digit(2)}@mail{digit(1)}.example.com"), 1)]
        if k == 1:
            return [(wrap(".".join(str(x) for x in rng.integers(0, 256, 4))), 2)]
        if k == 2:
            return [(wrap(card()), 3)]
        if k == 3:  # a long number that fails the check digit is no card
            body = digit(int(rng.choice([13, 14, 15, 16, 16, 16, 16])))
            return [(wrap(body), 3 if luhn(body) else 0)]
        if k in (4, 5):
            return [(f"+{digit(1)}", 4), (f"({digit(3)})", 4), (wrap(f"{digit(3)}-{digit(4)}"), 4)]
        if k == 6:
            return [(f"+{digit(2)}-{digit(3)}-{digit(6)}", 4)]
        if k == 7:
            return [(str(rng.choice(["token", "api_key", "secret", "password"])), 0), ("=", 0), (wrap(hexed(40)), 5)]
        if k == 8:
            return [(wrap(hexed(int(rng.choice([32, 40, 64])))), 5)]
        if k == 9:
            return [(str(rng.choice(["token:", "key:", "secret:"])), 0), (wrap(mixed(int(rng.integers(20, 48)))), 5)]
        if k == 10:
            return [(str(rng.choice(["token", "TOKEN", "key"])), 0), ("=", 0), (wrap(hexed(40).upper()), 5)]
        # look-alikes that are no personal data
        return [(str(rng.choice(["2.0.", "1998", "3.14", digit(2), digit(5), "1,000", "v1.2.3", "10:30", "2024-01-05", "50%%%", "A4", "covid19", digit(3) + ".", "+", "(c)", "x86", digit(7), "B2B", "user123", "3rd", "and/or", "[12]", "12345678", "abc-def-ghi", "http://a.example.com/b1/c22"])), 0)]

    out = []
    for _ in range(rows):
        items: list[tuple[str, int]] = [(word(), 0) for _ in range(rng.integers(1, 5))]
        for _ in range(rng.integers(0, 4)):
            items += [*entity(), *((word(), 0) for _ in range(rng.integers(1, 6)))]
        if rng.random() < 0.3:
            items += [(x, 0) for x in "Licensed under the Apache License, Version 2.0.".split()]
        out.append(([a for a, _ in items], [b for _, b in items]))
    return out


class Field:
    """Weights: one table of feature scores for the token itself, its left and its right neighbour, and transitions."""

    def __init__(self, names: dict[str, int], near: np.ndarray, turn: np.ndarray):
        self.names, self.near, self.turn = names, near, turn  # near: (3, features + 1, labels); the last row is for unseen features
        self.rows: dict[str, int] = {}
        self.table, self.used = np.zeros((3, 0, len(LABELS))), 0
        self.slack = 2 * float(turn.max() - turn.min())

    def emissions(self, words: list[str]) -> np.ndarray:
        """(tokens, labels): each distinct token's scores are summed once per worker."""
        rows = self.rows
        if len(rows) > 300_000:
            rows.clear()
            self.used = 0
        fresh = list({w for w in words if w not in rows})
        if fresh:
            # most tokens are plain words and share one row of scores
            cache: dict[tuple[str, ...], np.ndarray] = {}
            new = np.empty((3, len(fresh), len(LABELS)))
            for k, w in enumerate(fresh):
                rows[w] = self.used + k
                s = PLAIN if w.isalpha() and w.lower() not in CUES else shape(w)
                v = cache.get(s)
                if v is None:
                    v = cache[s] = self.near[:, [self.names.get(x, -1) for x in s]].sum(1)
                new[:, k] = v
            if self.used + len(fresh) > self.table.shape[1]:
                self.table = np.concatenate([self.table[:, : self.used], np.empty((3, max(len(fresh), self.used, 4096), len(LABELS)))], axis=1)
            self.table[:, self.used : self.used + len(fresh)] = new
            self.used += len(fresh)
        at = np.array([rows[w] for w in words], np.int64)
        e = self.table[0, at].copy()
        e[1:] += self.table[1, at[:-1]]
        e[:-1] += self.table[2, at[1:]]
        return e

    def decode(self, e: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best labels of sequences laid end to end; ends: past-the-last position of each."""
        n = len(e)
        out = np.zeros(n, np.int8)
        open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= self.slack) if n else np.zeros(0, np.int64)
        if not len(open_):
            return out
        # runs of open positions; a neighbour that is surely outside, or a sequence's end, bounds them
        new = np.concatenate([[True], (np.diff(open_) > 1) | np.isin(open_[1:], ends)])
        starts, sizes = open_[new], np.diff(np.append(np.flatnonzero(new), len(open_)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        first = np.isin(starts, np.append(ends, 0))
        last = np.isin(starts + sizes, ends)
        steps = int(sizes[0])
        best = e[starts] + np.where(first[:, None], 0.0, self.turn[0])
        back = np.zeros((steps, len(starts), len(LABELS)), np.int8)
        for t in range(1, steps):
            k = int(np.searchsorted(-sizes, -t, side="left"))  # runs longer than t
            through = best[:k, :, None] + self.turn[None]
            back[t, :k] = through.argmax(1)
            best[:k] = through.max(1) + e[starts[:k] + t]
        now = (best + np.where(last[:, None], 0.0, self.turn[:, 0])).argmax(1)
        for t in range(steps - 1, -1, -1):
            k = int(np.searchsorted(-sizes, -t, side="left"))
            out[starts[:k] + t] = now[:k]
            if t:
                now[:k] = back[t, np.arange(k), now[:k]]
        return out


PLAIN = ("plain",)


def train(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Exact likelihood by forward and backward sums over a padded batch, Adam steps. Tokens of one shape share a row of scores."""
    rows = training_table() if rows is None else rows
    names: dict[str, int] = {}
    shapes: dict[tuple[str, ...], int] = {(): 0}  # the empty shape stands beyond a row's ends
    L, T, n = len(LABELS), max(len(w) for w, _ in rows), len(rows)
    size = np.array([len(w) for w, _ in rows])
    y, own, left, right = (np.zeros((n, T), np.int64) for _ in range(4))
    for i, (words, labels) in enumerate(rows):
        for s in (known := [shape(w) for w in words]):
            shapes.setdefault(s, len(shapes))
            for x in s:
                names.setdefault(x, len(names))
        ids = [shapes[s] for s in known]
        y[i, : len(ids)], own[i, : len(ids)], left[i, 1 : len(ids)], right[i, : len(ids) - 1] = labels, ids, ids[:-1], ids[1:]
    has = np.zeros((len(shapes), len(names) + 1))
    for s, k in shapes.items():
        for x in s:
            has[k, names[x]] += 1
    live = np.arange(T)[None] < size[:, None]
    near, turn = np.zeros((3, len(names) + 1, L)), np.zeros((L, L))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (near, turn)]
    gold = np.eye(L)[y] * live[..., None]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for step in range(1, steps + 1):
        e = (has @ near[0])[own] + (has @ near[1])[left] + (has @ near[2])[right]
        f, b = e.copy(), np.zeros_like(e)
        for t in range(1, T):
            f[:, t] = np.where(live[:, t, None], lse(f[:, t - 1, :, None] + turn[None], 1) + e[:, t], f[:, t - 1])
        for t in range(T - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(turn[None] + (e[:, t + 1] + b[:, t + 1])[:, None], 2), 0)
        z = lse(f[:, -1], 1)
        d = gold - np.exp(np.minimum(f + b - z[:, None, None], 0)) * live[..., None]
        pulled = []
        for place in (own, left, right):
            by_shape = np.stack([np.bincount(place.ravel(), d[..., k].ravel(), len(shapes)) for k in range(L)], 1)
            by_shape[0] = 0
            pulled.append(has.T @ by_shape)
        both = np.zeros((L, L))
        for t in range(1, T):
            p = np.exp(np.minimum(f[:, t - 1, :, None] + turn[None] + (e[:, t] + b[:, t])[:, None] - z[:, None, None], 0))
            both += (gold[:, t - 1, :, None] * gold[:, t, None] - p * live[:, t, None, None]).sum(0)
        for x, grad, (m, v) in zip((near, turn), (np.stack(pulled) / n - decay * near, both / n - decay * turn), moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(names, near, turn)


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


class Cover:
    """The places that some spans cover, for one search a question."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def added_spans(field: Field, bodies: list[str], known: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans of the field that touch no known one, for each text."""
    words = [t.split() for t in bodies]
    ends = np.cumsum([len(w) for w in words])
    flat = [w for ws in words for w in ws]
    out: list[list[tuple[str, int, int]]] = [[] for _ in bodies]
    if not flat:
        return out
    labels = field.decode(field.emissions(flat), ends)
    hits = np.flatnonzero(labels)
    for i in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
        a = int(ends[i]) - len(words[i])
        own = labels[a : int(ends[i])]
        places = [m.span() for m in _NOT_SPACE.finditer(bodies[i])]
        t, taken = 0, Cover(known[i])
        while t < len(own):
            if not own[t]:
                t += 1
                continue
            u = t
            while u + 1 < len(own) and own[u + 1] == own[t]:
                u += 1
            start, end = places[t][0], places[u][1]
            piece = bodies[i][start:end]
            first, last = core_span(piece)
            start, end = start + first, start + last
            if start < end and not taken.touches(start, end):
                out[i].append((LABELS[own[t]], start, end))
            t = u + 1
    return out


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By kind in the order of LABELS, then start."""
    return sorted(base + added, key=lambda s: (LABELS.index(s[0]), s[1]))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans for every row of docs (doc_id, text)."""
    model = _packed(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*model)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                bodies = b.column(1).to_pylist()
                base = [base_spans(t) for t in bodies]
                more = added_spans(f, bodies, base)
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *counts, pa.array([hashlib.sha256(_digest(x).encode()).hexdigest() for x in base]), pa.array([_digest(all_spans(x, y)) for x, y in zip(base, more, strict=True)])],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _packed(f: Field) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    return f.names, f.near, f.turn


def mask_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; overlapping spans are joined. Null text stays null, n_chars follows the text."""
    model, schema = _packed(field or trained()), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*model)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                given = b.column(b.schema.get_field_index("text")).to_pylist()
                bodies = [t or "" for t in given]
                base = [base_spans(t) for t in bodies]
                out = []
                for raw, t, x, y in zip(given, bodies, base, added_spans(f, bodies, base), strict=True):
                    parts, done = [], 0
                    for kind, a, e in sorted(x + y, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            parts += [t[done:a], f"<{kind}>"]
                        done = max(done, e)
                    out.append(None if raw is None else "".join([*parts, t[done:]]))
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                cols["text"] = pa.array(out, pa.string())
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(b.column(b.schema.get_field_index("n_chars")).to_pylist(), out, strict=True)], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, schema)
