"""Ids of a public tokenizer for whole texts, many texts at a time.

Only for byte-level BPE tokenizers with word ends that drop white space: there a text's ids are its words' ids, and a
word's ids are those of its pieces.  Texts of ASCII and Latin-1 letters are lowered, cut into pieces and looked up in a
bounded per-worker table by array operations; pieces the table lacks are merged many at a time.  Other texts go word by
word, and words with characters beyond Latin or with a special token go to the library whole.  The ids are those the
library gives for the whole text.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import regex

from . import textkit as tk

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of one of the two generations that a worker keeps; pieces likewise.
KEPT_WORDS, KEPT_PIECES = 100_000, 100_000
#: Pieces of the table for plain texts.
TABLE_PIECES = 500_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_BEYOND = re.compile("[^\x00-ɏ]|<\\|")
_NONE = np.int64(1) << np.int64(60)
_PACK = [struct.Struct(f"<{k}I").pack for k in range(64)]

_open: dict[str, "PlainIds"] = {}


def _printable() -> dict[int, int]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in own)}


_BYTES = _printable()


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()


class Merges:
    """Byte-level BPE of many short pieces at once: each round merges, in every piece, its pair of least rank."""

    LONGEST = 24
    _FREE = np.int64(-1)

    def __init__(self, tok):
        model = json.loads(tok.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letter = [chr(_BYTES.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in letter], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letter], np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.bits = 18
        self.key, self.value = np.full(1 << self.bits, self._FREE), np.zeros(1 << self.bits, np.int64)
        todo, at = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):  # linear probing, all keys a step at a time
            free = self.key[at] == self._FREE
            pick = todo[free]
            self.key[at[free]] = key[pick]
            placed = self.key[at] == key[todo]
            self.value[at[placed]] = todo[placed] << 20 | np.array([vocab[pairs[t][0] + pairs[t][1]] for t in todo[placed]], np.int64)
            todo, at = todo[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id, or a value above all for pairs that don't merge (negative ids pad)."""
        key = a << 20 | b
        at, out = self._slot(key), np.full(a.shape, _NONE)
        for _ in range(self.probes):
            hit = self.key[at] == key
            out = np.where(hit, self.value[at], out)
            at = (at + 1) & ((1 << self.bits) - 1)
        return np.where((a < 0) | (b < 0), _NONE, out)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((1, 4), (5, 8), (9, 12), (13, 17), (18, self.LONGEST)):
            chosen = np.flatnonzero((size >= low) & (size <= high))
            for i in range(0, len(chosen), 1 << 13):
                self._some(pieces, chosen[i : i + (1 << 13)], high, out)
        return out

    def _some(self, pieces: list[bytes], which: np.ndarray, wide: int, out: list[bytes]) -> None:
        own = [pieces[k] for k in which]
        size = np.fromiter(map(len, own), np.int64, len(own))
        raw = np.frombuffer(b"".join(own), np.uint8)
        col = np.arange(wide)
        inside = col < size[:, None]
        ids = np.full((len(own), wide), -1, np.int64)
        ids[inside] = self.inner[raw]
        ids[np.arange(len(own)), size - 1] = self.final[raw[np.cumsum(size) - 1]]
        rank = np.full(ids.shape, _NONE)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(own))
        final = ids.copy()
        while True:
            j = rank.argmin(axis=1)
            rows = np.arange(len(j))
            best = rank[rows, j]
            go = best < _NONE
            if not go.all():
                final[live[~go]] = ids[~go]
                live, ids, rank, j, best = live[go], ids[go], rank[go], j[go], best[go]
                rows = rows[: len(live)]
            if not len(live):
                break
            shift = np.minimum(col + (col > j[:, None]), wide - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            rank = np.take_along_axis(rank, shift, axis=1)
            ids[:, -1], rank[:, -1] = -1, _NONE
            ids[rows, j] = best & 0xFFFFF
            rank[rows, j] = np.where(j + 1 < wide, self._rank(ids[rows, j], ids[rows, np.minimum(j + 1, wide - 1)]), _NONE)
            left = np.maximum(j - 1, 0)
            rank[rows, left] = np.where(j > 0, self._rank(ids[rows, left], ids[rows, j]), rank[rows, left])
        have = final >= 0
        flat, per = final[have].astype("<u4").tobytes(), have.sum(axis=1) * 4
        at = np.concatenate([[0], np.cumsum(per)]).tolist()
        for n, k in enumerate(which.tolist()):
            out[k] = flat[at[n] : at[n + 1]]


class _Cells(dict):
    """Cells of ids by text, in two generations: what is used again moves to the young one, and the old one is dropped
    when the young one is full.  A new cell is empty and noted in `new` until it is filled."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.new = most, {}, []

    def __missing__(self, key: str) -> list:
        cell = self.old.get(key)
        if cell is None:
            cell = [key]
            self.new.append(cell)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = cell
        return cell


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.merges = self.tok.model, Merges(self.tok)
        self.words, self.pieces = _Cells(KEPT_WORDS), _Cells(KEPT_PIECES)

    def _cut(self, word: str) -> list[list] | None:
        """Cells of the word's pieces; None if the library has to see it whole."""
        get = self.pieces.__getitem__
        if word.isascii():
            if word.isalpha():
                return [get(word.lower())]
            if word[:-1].isalpha() and word[-1] in ".,!?;:":
                return [get(word[:-1].lower()), get(word[-1])]
            if "<|" in word:
                return None
            return list(map(get, _PIECE.findall(word.lower())))
        if _BEYOND.search(word):
            return None
        return list(map(get, _PIECE.findall("".join(map(str.lower, word)))))

    def _fill(self) -> None:
        new, self.words.new = self.words.new, []
        cut = [self._cut(c[0]) for c in new]
        fresh, self.pieces.new = self.pieces.new, []
        raw = [c[0].encode() for c in fresh]
        for c, b, r in zip(fresh, self.merges.encode(raw), raw, strict=True):
            c[0] = b or _packed([t.id for t in self.model.tokenize(r.decode("latin-1").translate(_BYTES))])
        for c, parts in zip(new, cut, strict=True):
            c[0] = _packed(self.tok.encode(c[0], add_special_tokens=False).ids) if parts is None else parts[0][0] if len(parts) == 1 else b"".join([p[0] for p in parts])

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit numbers."""
        cells = list(map(self.words.__getitem__, words))
        if self.words.new:
            self._fill()
        return [c[0] for c in cells]


_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[tk.SPACE] = 0
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _LETTER
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32


def _plain(s: tk.Slice) -> np.ndarray:
    """Which documents are ASCII and Latin-1 letters without the start of a special token."""
    d, n = s.data, len(s.data)
    odd = np.zeros(n + 1, np.int64)
    after = np.empty(n, np.uint8)
    if n:
        after[:-1], after[-1] = d[1:], 0
    lead = d == 0xC3
    trail = (d & 0xC0) == 0x80
    led = np.zeros(n, bool)
    led[1:] = lead[:-1]
    bad = (d >= 0x80) & ~lead & ~(trail & led)
    bad |= lead & ((after == 0x97) | (after == 0xB7))
    bad |= (d == 0x3C) & (after == 0x7C)
    np.cumsum(bad, out=odd[1:])
    return odd[s.off[1:]] == odd[s.off[:-1]]


class PlainIds:
    """Ids of slices of documents, with how many ids each white-space word has."""

    BITS = 20

    def __init__(self, path: str):
        self.slow = WordIds(path)
        self._clear()

    def _clear(self, pieces: int = 0) -> None:
        """An empty table, larger than usual if one slice has that many pieces."""
        self.bits = max(self.BITS, int(2 * pieces).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, tk.U), np.zeros(1 << self.bits, np.int64)
        self.flat, self.used, self.count = np.zeros(1 << 18, np.uint32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """start << 24 | length of each piece's ids, -1 where the table lacks it."""
        at = (h >> tk.U(64 - self.bits)).astype(np.int64)
        have = self.key[at]
        out = np.where(have == h, self.value[at], -1)
        todo = np.flatnonzero((have != h) & (have != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            have = self.key[at[todo]]
            hit = have == h[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (have != 0)]
        return out

    def _add(self, h: np.ndarray, ids: list[bytes]) -> None:
        per = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        new = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        value = (self.used + np.cumsum(per) - per) << 24 | per
        self.used += len(new)
        self.count += len(ids)
        at = (h >> tk.U(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.key[at[todo]] == 0
            self.key[at[todo[free]]] = h[todo[free]]
            mine = self.key[at[todo]] == h[todo]
            self.value[at[todo[mine]]] = value[todo[mine]]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slice(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, how many each word has, and the first word of each document (n + 1)."""
        word_starts, _, first = s.spans(tk.NOT_SPACE)
        plain = _plain(s)
        data, n = s.data, len(s.data)
        per_word = np.zeros(len(word_starts), np.int64)
        if not plain.all():
            data = data.copy()
            data[np.repeat(~plain, np.diff(s.off))] = 0x20
        low = _LOW[data]
        capital = np.zeros(n, bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        low[capital] += 32
        kind = _KIND[data]
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge[s.off] = True
        # contractions: an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it
        p = np.flatnonzero((data == 0x27) & edge[:-1])
        p = p[(p + 1 < n)]
        p = p[edge[p + 1]]
        if len(p):
            stop = s.off[np.searchsorted(s.off, p, "right")]
            b1 = np.where(p + 1 < stop, low[np.minimum(p + 1, n - 1)], 0)
            b2 = np.where(p + 2 < stop, low[np.minimum(p + 2, n - 1)], 0)
            one = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
            two = ((b1 == 0x72) | (b1 == 0x76)) & (b2 == 0x65) | (b1 == 0x6C) & (b2 == 0x6C)
            edge[p[one | two] + 1] = False
            edge[p[one] + 2] = True
            edge[p[two] + 2] = False
            edge[p[two] + 3] = True
        bounds = np.flatnonzero(edge)
        solid = kind[bounds[:-1]] != 0 if n else np.zeros(0, bool)
        starts, ends = bounds[:-1][solid], bounds[1:][solid]
        c = np.zeros(n + 1, tk.U)
        with np.errstate(over="ignore"):
            np.cumsum(tk._TABLE[low] * tk.powers(tk._P, n)[:n], out=c[1:])
            h = tk.mix((c[ends] - c[starts]) * tk.powers(tk._PI, n)[starts] + (ends - starts).astype(tk.U) * tk.U(0xD6E8FEB86659FD93))
        if self.count > TABLE_PIECES:
            self._clear()
        found = self._find(h)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            hs, at = np.unique(h[lost], return_index=True)
            at = lost[at]
            if self.count + len(hs) > 3 << self.bits >> 2:
                hs, at = np.unique(h, return_index=True)
                self._clear(len(hs))
                lost = np.arange(len(h))
            flat = low.tobytes()
            raw = [flat[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            model = self.slow.model
            got = [b or _packed([t.id for t in model.tokenize(r.decode("latin-1").translate(_BYTES))]) for b, r in zip(self.slow.merges.encode(raw), raw, strict=True)]
            self._add(hs, got)
            found[lost] = self._find(h[lost])
        per = found & 0xFFFFFF
        total = int(per.sum())
        take = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + np.repeat(found >> 24, per)
        ids = self.flat[take]
        if len(word_starts):
            sums = np.concatenate([[0], np.cumsum(per)])
            per_word = np.diff(sums[np.append(np.searchsorted(starts, word_starts), len(starts))])
        if plain.all():
            return ids, per_word, first
        # texts that aren't plain, word by word
        parts = {}
        for k in np.flatnonzero(~plain):
            words = _WORD.findall(s.text(k))
            got = self.slow.of_words(words)
            per_word[first[k] : first[k + 1]] = np.fromiter(map(len, got), np.int64, len(got)) // 4
            parts[k] = np.frombuffer(b"".join(got), "<u4")
        at = np.concatenate([[0], np.cumsum(per_word)])[first]
        out = np.empty(at[-1], np.uint32)
        mine = np.repeat(plain, np.diff(at))
        out[mine] = ids
        for k, x in parts.items():
            out[at[k] : at[k + 1]] = x
        return out, per_word, first


def word_ids(path: str) -> PlainIds:
    if path not in _open:
        _open[path] = PlainIds(path)
    return _open[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
