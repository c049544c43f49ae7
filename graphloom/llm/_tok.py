"""Byte-level BPE ids by the tokenizers library, with every distinct word encoded once.

The vocabulary file asks for the byte-level pre-tokenizer. Its split pattern is evaluated here on whole batches of code
points, each distinct pre-token is given to the library's BPE model once, and ids are spread back by numpy. Files that
ask for any other normaliser or pre-tokenizer go through ``encode_batch`` unchanged.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from operator import attrgetter

import numpy as np

from ._text import mix, powers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_WORDS = 1 << 19
CACHE_POINTS = 1 << 22
ID = attrgetter("id")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_classes: np.ndarray | None = None
_loaded: dict[tuple[str, bool], Encoder] = {}


def classes() -> np.ndarray:
    """Class of every code point as the split pattern sees it."""
    global _classes
    if _classes is None:
        import regex

        out = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                out[a : b + 1] = kind
        out[0xD800:0xE000] = OTHER
        _classes = out
    return _classes


def pre_tokens(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for texts laid one after another (off: their borders).

    Same cuts as ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 255, kind[:-1]
    prev[off[:-1][off[:-1] < n]] = 255
    start = kind != prev
    space = kind == SPACE
    # The last white space before a text's next black character leaves its run; a blank joins what follows.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    # Contractions: an apostrophe that starts a token, then s, t, m, d, re, ve or ll. They cut the letters that follow.
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        room = np.searchsorted(off, quote, "right")
        left = off[np.minimum(room, len(off) - 1)] - quote
        at = lambda k: np.where(left > k, points[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        length = np.where(one, 2, np.where(two, 3, 0))
        q, length = quote[length > 0], length[length > 0]
        start[q + 1] = False
        tail = q + length
        ok = tail < n
        q, tail = q[ok], tail[ok]
        inside = (kind[tail] == LETTER) & ~edge[tail]  # the rest of the letters is a token of its own
        start[tail[inside]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts. One per worker process; its memory of words is bounded by CACHE_WORDS and CACHE_POINTS.

    The strings of added tokens are that token wherever they stand in a text, as in the library; ``special_as_text`` reads
    them as ordinary text. Words are looked up by a hash and then compared, so a collision is seen: such a slice goes
    through the library.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = all(t.get("special") and not (t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
        self.fast = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and plain
        marks = {} if special_as_text else {t["content"].encode(): t["id"] for t in added}
        self.marks = marks
        self.mark = re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=lambda m: (-len(m), m)))) if marks else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.model = self.tok.model
        self.code = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) if self.fast else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.seen, self.seen_first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, bool)

    def shrink(self) -> None:
        """Forgets words that were not met again since they were learned or the last call; all, if that is too few."""
        keep = self.met
        if not keep.any() or keep.sum() > CACHE_WORDS // 2 or np.diff(self.seen_first)[keep].sum() > CACHE_POINTS // 2:
            return self.clear()
        new = np.cumsum(keep) - 1
        stays = keep[self.slot]
        self.keys, self.slot = self.keys[stays], new[self.slot[stays]]
        for values, starts in (("ids", "first"), ("seen", "seen_first")):
            size = np.diff(getattr(self, starts))
            setattr(self, values, getattr(self, values)[np.repeat(keep, size)])
            setattr(self, starts, np.concatenate([[0], np.cumsum(size[keep])]))
        self.met = np.zeros(int(keep.sum()), bool)

    def learn(self, keys: np.ndarray, text: list[str]) -> None:
        tokenize, table = self.model.tokenize, self.table
        got = [tokenize(w.encode().decode("latin1").translate(table)) for w in text]
        size = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(map(ID, chain.from_iterable(got)), np.uint32, int(size.sum()))
        points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        base = len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])
        self.seen_first = np.concatenate([self.seen_first, self.seen_first[-1] + np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))])
        self.seen = np.concatenate([self.seen, points])
        self.met = np.concatenate([self.met, np.zeros(len(text), bool)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, where, keys), np.insert(self.slot, where, base + np.arange(len(keys)))

    def library(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        got = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(size.sum())), np.concatenate([[0], np.cumsum(size)])

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start."""
        if not self.fast:
            return self.library(data, off)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        whole = data.tobytes()
        cuts = [(m.start(), m.end(), self.marks[m[0]]) for m in self.mark.finditer(whole)] if self.mark else []
        if cuts:  # a mark lies within one text, unless texts that stand side by side only seem to form it
            home = np.searchsorted(off, [a for a, _, _ in cuts], "right")
            if any(e > off[h] for (_, e, _), h in zip(cuts, home.tolist(), strict=True)):
                return self.library(data, off)
            return self.around(data, off, cuts)
        return self.words(whole, data, off)

    def around(self, data: np.ndarray, off: np.ndarray, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The parts between marks are encoded as texts of their own, each mark as its id."""
        edges = np.unique(np.concatenate([off, [x for a, b, _ in cuts for x in (a, b)]])).astype(np.int64)
        at = np.searchsorted(edges, [a for a, _, _ in cuts])
        is_mark = np.zeros(len(edges) - 1, bool)
        is_mark[at] = True
        size = np.diff(edges)
        rest = data[np.repeat(~is_mark, size)]
        ids, first = self.words(rest.tobytes(), rest, np.concatenate([[0], np.cumsum(size[~is_mark])])) if len(rest) else (np.zeros(0, np.uint32), np.zeros(int((~is_mark).sum()) + 1, np.int64))
        n = np.ones(len(size), np.int64)
        n[~is_mark] = np.diff(first)
        start = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(int(start[-1]), np.uint32)
        out[np.repeat(~is_mark, n)] = ids
        out[start[at]] = [i for _, _, i in cuts]
        return out, start[np.searchsorted(edges, off)]

    def known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def words(self, whole: bytes, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = whole.decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        border = lead[off].astype(np.int64)
        start = pre_tokens(points, border)
        end = np.append(start[1:], len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        fwd, back = powers(len(points) + 1)
        np.cumsum(self.code[points] * fwd[:-1], out=sums[1:])
        key = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
        uniq, at, inv = np.unique(key, return_index=True, return_inverse=True)
        if not same(points, start, end, start[at][inv], end[at][inv], points):
            return self.library(data, off)
        known = self.known(uniq)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_WORDS or len(self.seen) + int((end - start)[at[~known]].sum()) > CACHE_POINTS:
                self.shrink()
                known = self.known(uniq)
            new = at[~known]
            self.learn(uniq[~known], [text[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        slot = self.slot[np.searchsorted(self.keys, uniq)]
        if not same(points, start[at], end[at], self.seen_first[slot], self.seen_first[slot + 1], self.seen):
            return self.library(data, off)
        self.met[slot[known]] = True
        size = (self.first[slot + 1] - self.first[slot])[inv]
        base = self.first[slot][inv]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(base - total[:-1], size)]
        return ids, total[np.searchsorted(start, border)]


def same(x: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray, y: np.ndarray) -> bool:
    """Whether every x[start:end] equals its y[start2:end2]."""
    size = end - start
    if not np.array_equal(size, end2 - start2):
        return False
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    return bool(np.array_equal(x[at + np.repeat(start - first, size)], y[at + np.repeat(start2 - first, size)]))


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(path, special_as_text)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
