"""Chunkers: sequential within a text, independent between texts, so each text is one row of an Arrow batch."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import words as W

MAX_CHARS, OVERLAP = 1800, 300
SCHEMA = "text_id long, seq int, level string, start_char int, end_char int, approx_tokens int, content string"
Piece = tuple[str, int, int, str]


def split_paragraphs(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs, the long ones as overlapping windows."""
    if overlap >= most:
        raise ValueError("overlap must be smaller than a chunk")
    out = []
    for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", text))):
        starts = [0] if len(p) <= most else range(0, len(p) - overlap, most - overlap)
        out += filter(None, (p[a : a + most].strip() for a in starts))
    return out


def by_paragraph(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Piece]:
    """Paragraphs packed greedily; each chunk starts with the last paragraphs of the one before; last the whole text."""
    paras = split_paragraphs(text, most, overlap)
    if not paras:
        return []
    whole = "\n\n".join(paras)
    offsets = np.cumsum([0] + [len(p) + 2 for p in paras]).tolist()
    out: list[Piece] = []
    i = 0
    while True:
        first, size = i, len(paras[i])
        i += 1
        while i < len(paras) and size + len(paras[i]) + 2 <= most:
            size += len(paras[i]) + 2
            i += 1
        out.append(("local", offsets[first], offsets[i - 1] + len(paras[i - 1]), "\n\n".join(paras[first:i])))
        if i == len(paras):
            break
        back, shared = i, 0
        while back > first and shared < overlap:
            back -= 1
            shared += len(paras[back]) + 2
        i = max(back, first + 1)
    if len(whole) > most or len(out) > 1:
        out.append(("document", 0, len(whole), whole))
    return out


def tfidf(sentences: list[str]) -> list[dict[str, float]]:
    """Unit vectors over words and word pairs: smooth inverse document frequency, English function words left out."""
    stop = set(W.FUNCTION_WORDS)
    bags = []
    for s in sentences:
        w = [x for x in re.findall(r"\b\w\w+\b", s.lower()) if x not in stop]
        bags.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    seen = Counter(t for b in bags for t in b)
    out = []
    for b in bags:
        v = {t: n * (math.log((1 + len(bags)) / (1 + seen[t])) + 1) for t, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()} if norm else {})
    return out


def by_meaning(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Piece]:
    """Sentences, cut where neighbours are less alike than the lowest quarter or a chunk would be too long."""
    sentences = [s for x in re.split(r"(?<=[.!?])\s+", text) if (s := x.strip())]
    if not sentences:
        return []
    if len(sentences) == 1:
        return [("local", 0, len(sentences[0]), sentences[0])]
    v = tfidf(sentences)
    alike = [sum(x * b.get(t, 0.0) for t, x in a.items()) for a, b in zip(v, v[1:])]
    low = float(np.percentile(alike, 25))
    chunks, current, size = [], [sentences[0]], len(sentences[0])
    for s, score in zip(sentences[1:], alike, strict=True):
        if score < low or size + len(s) + 1 > most:
            chunks.append(" ".join(current))
            keep, shared = [], 0
            for prev in reversed(current):
                if overlap <= 0 or shared >= overlap:
                    break
                keep.insert(0, prev)
                shared += len(prev) + 1
            current, size = keep, sum(len(x) + 1 for x in keep)
        current.append(s)
        size += len(s) + 1
    chunks.append(" ".join(current))
    out: list[Piece] = []
    at = 0
    for c in chunks:
        found = text.find(c, at)
        a = at if found < 0 else found
        out.append(("local", a, a + len(c), c))
        at = a + len(c)
    if len(text) > most or len(out) > 1:
        out.append(("document", 0, len(text), text))
    return out


#: Characters of text after which rows leave for Spark, so that a batch's results aren't held at once.
SLICE = 1_000_000


def pieces(frames: Iterator[pd.DataFrame], cut: Callable[[str], list[Piece]]) -> Iterator[pd.DataFrame]:
    names = ["text_id", "seq", "level", "start_char", "end_char", "approx_tokens", "content"]
    for d in frames:
        rows, size = [], 0
        for i, t in zip(d["text_id"], d["content"], strict=True):
            rows += [(i, n, level, a, z, max(1, len(c) // 4), c) for n, (level, a, z, c) in enumerate(cut(t or ""))]
            size += len(t or "")
            if size >= SLICE:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _each(texts: DataFrame, cut: Callable[[str], list[Piece]]) -> DataFrame:
    return texts.select("text_id", "content").mapInPandas(lambda frames: pieces(frames, cut), SCHEMA)


def paragraph_chunks(texts: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    return _each(texts, lambda t: by_paragraph(t, most, overlap))


def semantic_chunks(texts: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    return _each(texts, lambda t: by_meaning(t, most, overlap))
