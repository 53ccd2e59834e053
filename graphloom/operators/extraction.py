"""Extraction and embedding through protocols, with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import rules as R


class Extractor(Protocol):
    def triples(self, text: str) -> list[tuple[str, str, str]]: ...

    def keep(self, triples: list[tuple[str, str, str]]) -> list[bool | None]:
        """A verdict per triple; None if the judge gave none."""
        ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OfflineExtractor:
    """Neighbouring capitalised words as subject and object, what stands between as predicate: repeatable, no model."""

    _PATTERN = re.compile(r"\b([^\W\d_][\w'-]{2,})\s+((?:[^\W\d_]+\s+){1,2})([^\W\d_][\w'-]{2,})")

    def triples(self, text: str) -> list[tuple[str, str, str]]:
        return [(m[1], m[2].strip(), m[3]) for s in re.split(r"(?<=[.!?])\s+", text) for m in self._PATTERN.finditer(s)]

    def keep(self, triples: list[tuple[str, str, str]]) -> list[bool | None]:
        return [s.lower() != o.lower() for s, _, o in triples]


class HashEmbedder:
    """Unit vectors from hashed words."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in t.lower().split():
                d = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "little") % self.dims] += 1 if d[4] & 1 else -1
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return out


#: Triples that a judge is shown at once.
JUDGED = 15


def _judged(model: Extractor, found: list[tuple[str, str, str]]) -> list[bool | None]:
    return [x for i in range(0, len(found), JUDGED) for x in model.keep(found[i : i + JUDGED])]


EXTRACTED = "kind string, chunk_id string, n int, subject string, predicate string, object string, reason string"


#: Characters of text after which rows leave for Spark, so that a batch's triples aren't held at once.
SLICE = 1_000_000


def extracted(frames: Iterator[pd.DataFrame], model: Extractor) -> Iterator[pd.DataFrame]:
    names = ["kind", "chunk_id", "n", "subject", "predicate", "object", "reason"]
    for d in frames:
        rows, size = [], 0
        for i, text in zip(d["chunk_id"], d["content"], strict=True):
            found = model.triples(text)
            verdict = _judged(model, found)
            open_ = [k for k, x in enumerate(verdict) if x is None]
            for k, x in zip(open_, _judged(model, [found[k] for k in open_]), strict=True):
                verdict[k] = x
            rows += [("triple" if x else "rejection", i, k, *t, None if x else "judge" if x is False else "no_verdict") for k, (t, x) in enumerate(zip(found, verdict, strict=True))]
            size += len(text)
            if size >= SLICE:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def extract(chunks: DataFrame, make: Callable[[], Extractor] = OfflineExtractor) -> DataFrame:
    """kind is triple, rejection or skip.  Chunks that hold nothing are skipped by rule; the judge is asked once more
    about triples it gave no verdict on, and what still has none is rejected."""
    c = chunks.select("chunk_id", "content", R.chunk_skip_reason("content").alias("reason"))
    skips = c.filter("reason is not null").select(F.lit("skip").alias("kind"), "chunk_id", F.lit(0).alias("n"), *(F.lit(None).cast("string").alias(x) for x in ("subject", "predicate", "object")), "reason")

    raw = c.filter("reason is null").select("chunk_id", "content").mapInPandas(lambda frames: extracted(frames, make()), EXTRACTED)
    e = raw.withColumn("subject", X.normalize_entity(F.col("subject"))).withColumn("object", X.normalize_entity(F.col("object"))).withColumn("predicate", X.normalize_predicate(F.col("predicate")))
    why = F.coalesce("reason", R.triple_rejection_reason("subject", "predicate", "object"))
    return e.select(F.when(why.isNull(), "triple").otherwise("rejection").alias("kind"), "chunk_id", "n", "subject", "predicate", "object", why.alias("reason")).unionByName(skips)


def embed(rows: DataFrame, ids: str, text: str, make: Callable[[], Embedder] = HashEmbedder, batch: int = 100, longest: int | None = 8000) -> DataFrame:
    """ids and embedding; texts on one line and cut to the model's longest input (`longest` characters, as the engine this
    follows does; None for no cut)."""
    kind = dict(rows.dtypes)[ids]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for d in frames:
            for i in range(0, len(d), batch):
                part = d.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": model.embed([str(x).replace("\n", " ")[:longest] for x in part["text"]])})

    return rows.select(F.col(ids).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", ids)


def lemma(phrase: str) -> str:
    """A small rule-based English lemmatizer, word by word; an approximation."""
    out = []
    for w in phrase.lower().split():
        if len(w) > 4 and w.endswith("ies"):
            w = w[:-3] + "y"
        elif len(w) > 4 and w.endswith(("ches", "shes", "sses", "xes")):
            w = w[:-2]
        elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
            w = w[:-1]
        out.append(w)
    return " ".join(out)


def lemmatize(names: DataFrame, col: str, out: str, fn: Callable[[str], str] = lemma) -> DataFrame:
    """Distinct names with their lemma."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            yield pd.DataFrame({col: d[col], out: d[col].map(fn, na_action="ignore")})

    return names.select(col).distinct().mapInPandas(run, f"{col} string, {out} string")
