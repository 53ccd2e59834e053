"""Many questions through routing, search, seeds, walk, context and scope checks in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import graph as G
from ..operators import retrieval as T
from ..operators.relational import ends
from ..operators.shared import materialize
from ..operators.views import Views

#: Questions of a block: their vectors go to every task of the search.
BLOCK = 1000


def _first(df: DataFrame, k: int, *order, per: tuple[str, ...] = ("query_id",), out: str = "rank") -> DataFrame:
    """The k first rows of each question, ranked from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col(out) <= k)


def nearest(vectors: DataFrame, ids: str, questions: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """query_id, ids, score: of each task's vectors those that may be among a question's k nearest (questions: query_id, q).

    Each task measures its vectors against a block of questions by a matrix product; what that leaves is scored as `cosine`
    does it, sum by sum, so ties stay ties.
    """
    q = [(r.query_id, r.q) for r in questions.select("query_id", "q").filter("q is not null").collect()]  # numbers of a question, not of its texts
    kind = dict(vectors.dtypes)[ids]
    out = None
    for at in range(0, max(1, len(q)), BLOCK):
        part = q[at : at + BLOCK]
        numbers, asked = np.array([i for i, _ in part], np.int64), np.array([x for _, x in part], float).reshape(len(part), -1)

        def run(batches: Iterator[pa.RecordBatch], numbers: np.ndarray = numbers, asked: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            best = np.full(len(numbers), -np.inf)
            kept: list[tuple] = []
            own = _length(asked)
            unit = asked / np.where(own > 0, own, 1)[:, None]
            for b in batches if len(numbers) else ():
                for a in range(0, b.num_rows, 2000):
                    d = b.slice(a, 2000)
                    x = d.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(d.num_rows, -1)
                    long = _length(x)
                    s = (x / np.where(long > 0, long, 1)[:, None]) @ unit.T
                    s[long == 0], s[:, own == 0] = -2.0, -2.0  # no cosine: last
                    if len(s) >= k:
                        best = np.maximum(best, np.partition(s, len(s) - k, axis=0)[len(s) - k])
                    i, j = np.nonzero(s >= best - 1e-9)
                    kept.append((d.column(0).take(pa.array(i)), j, s[i, j], _sum(x[i] * asked[j]), long[i] * own[j]))
            if kept:
                c, (j, near, dot, norm) = pa.chunked_array([x[0] for x in kept]), (np.concatenate([x[n] for x in kept]) for n in range(1, 5))
                use = near >= best[j] - 1e-9
                score = np.divide(dot[use], norm[use], out=np.zeros(int(use.sum())), where=norm[use] != 0)
                t = pa.table([pa.array(numbers[j[use]]), c.filter(pa.array(use)), pa.array(score, mask=norm[use] == 0)], ["query_id", ids, "score"])
                yield from t.to_batches(max_chunksize=100_000)

        found = vectors.filter(F.col(vector).isNotNull()).select(ids, vector).mapInArrow(run, f"query_id long, {ids} {kind}, score double")
        out = found if out is None else out.unionByName(found)
    return out


def _sum(x: np.ndarray) -> np.ndarray:
    """Row sums from left to right, as a fold adds."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s += x[:, k]
    return s


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum(x * x))


class KnowledgeEngine:
    """Answers come as ranked chunks with their scores; a language model may turn them into prose (operators.models.answer)."""

    def __init__(self, views: Views, hops: int = 2, near: int = 15, seeds: int = 20, context: int = 35, reports: int = 5, scope: T.Scope | None = None, scores: DataFrame | None = None):
        """scope: a strict one keeps search, communities, walks and context inside its texts, and each is checked.
        scores: conceptness of entities, without which they don't restrict seeds and walks."""
        self.v, self.hops, self.near, self.n_seeds, self.context, self.reports = views, hops, near, seeds, context, reports
        self.scope = scope if scope and not scope.empty() else None
        self.scores = scores

    def answer(self, questions: DataFrame) -> DataFrame:
        """questions: query_id, question, vec_id (whose vector stands for the question's) -> query_id, place, chunk_id, score, tier.

        Tiers: 1 cited by the nearest reports, 2 met early on the walk, 3 near the question, 4 met later.
        """
        v = self.v
        self.edges = materialize(G.directed_edges(v.tg), "edges")
        nodes = v.nodes.select("node_id", F.col("node_id").alias("label"))
        self.flags = materialize(G.node_flags(nodes, self.edges.select("s", "p", "o"), self.scores), "flags")
        self.inside = materialize(self.scope.chunks(v.files, v.chunks), "scope") if self.scope else None
        return self._answers(questions)

    def _within(self, chunks: DataFrame) -> DataFrame:
        return chunks if self.inside is None else chunks.join(self.inside, "chunk_id", "left_semi")

    def _checked(self, found: DataFrame, what: str) -> DataFrame:
        return T.check_scope(found, self.inside, what) if self.scope and self.scope.strict else found

    def _routed(self, q: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, comm_id) of five communities and (query_id, chunk_id, rank from 0) of what their reports cite."""
        v = self.v
        if self.scope and self.scope.strict:  # reports are of the whole graph: communities come from the scope's own entities
            inside = ends(self._within(v.tg), out="node_id").join(v.mem.select("node_id", "comm_id"), "node_id")
            top = inside.groupBy("comm_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comm_id").limit(self.reports)
            return q.select("query_id").join(F.broadcast(top.select("comm_id"))), q.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("rank")).limit(0)
        r = v.reports.filter("report_embedding is not null")
        near = materialize(_first(nearest(r.select("comm_id", "report_embedding"), "comm_id", q, self.reports, "report_embedding"), self.reports, F.desc_nulls_last("score"), "comm_id", out="r"), "reports")
        # thirty citations in all are no more than the first thirty of each report
        each = self._within(r.select("comm_id", F.posexplode("cited_chunk_ids").alias("pos", "chunk_id"))).groupBy("comm_id", "chunk_id").agg(F.min("pos").alias("pos"))
        each = materialize(_first(each, 30, "pos", per=("comm_id",)).drop("rank"), "cited")
        cites = near.select("query_id", "comm_id", "r").join(each, "comm_id").groupBy("query_id", "chunk_id").agg(F.min(F.struct("r", "pos")).alias("at"))
        return near.select("query_id", "comm_id"), _first(cites, 30, "at", "chunk_id").select("query_id", "chunk_id", (F.col("rank") - 1).alias("rank"))

    def _answers(self, questions: DataFrame) -> DataFrame:
        v = self.v
        vec = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
        q = materialize(questions.join(vec, "vec_id").withColumn("words", X.tokens(F.col("question"))), "block")
        routed, cites = (materialize(x, "routed") for x in self._routed(q))
        scored = nearest(self._within(v.ec), "chunk_id", q, self.near)
        top = self._checked(materialize(_first(scored, self.near, F.desc_nulls_last("score"), "chunk_id"), "near"), "vector search")
        # seeds: entities of the first thirty chunks, cited ones first
        found = cites.select("query_id", "chunk_id", "rank").unionByName(top.select("query_id", "chunk_id", (F.col("rank") + 1000).alias("rank"))).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("at"))
        t = v.tg.join(materialize(_first(found, 30, "at", "chunk_id").select("query_id", "chunk_id"), "found"), "chunk_id")
        ok = self.flags.filter("valid_seed").select("node_id", "label")
        cand = ends(t, "s", "o", "node_id", "query_id").distinct().join(ok, "node_id").join(v.mem.select("node_id", "comm_id"), "node_id", "left").join(q.select("query_id", "words"), "query_id")
        cand = cand.join(routed.withColumn("hit", F.lit(True)), ["query_id", "comm_id"], "left")
        score = X.label_relevance(F.col("label"), F.col("words")) + F.when(F.col("hit"), 0.3).otherwise(0.0)
        seeds = _first(cand.withColumn("score", score).filter("score > 0"), self.n_seeds, F.desc("score"), "node_id").select("query_id", "node_id", "rank")
        scoped = self._within(v.tg).select("s", "p", "o").distinct() if self.scope and self.scope.strict else None
        steps = G.traverse(self.edges, self.flags, materialize(seeds, "seeds"), v.mem, routed, q.select("query_id", "words"), self.hops, 80, self.n_seeds, 40, 160, scoped_edges=scoped)
        walk = self._within(steps.select("query_id", "step", F.explode("chunks").alias("chunk_id"))).groupBy("query_id", "chunk_id").agg(F.min("step").alias("step"))
        return self._checked(self._context(cites, walk, top), "context")

    def _context(self, cites: DataFrame, walk: DataFrame, top: DataFrame, keep_report: int = 8, keep_walk: int = 12) -> DataFrame:
        """Must-keep citations, must-keep walk chunks, nearest chunks, the rest of the walk, for each question."""
        one = cites.filter(F.col("rank") < keep_report)
        first = one.select("query_id", "chunk_id", F.lit(1).alias("tier"), F.col("rank").cast("double").alias("k"), (1.0 - F.col("rank") * 0.05).alias("score"))
        w = walk.join(one.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("s", F.greatest(F.lit(0.5), 1.0 - F.col("step") * 0.02))
        w = _first(w, max(self.context, keep_walk), F.desc("s"), "chunk_id", out="r")
        kept = F.col("r") <= keep_walk
        second = w.select("query_id", "chunk_id", F.when(kept, 2).otherwise(4).alias("tier"), (-F.col("s")).alias("k"), F.when(kept, F.col("s")).otherwise(F.col("s") * 0.8).alias("score"))
        third = top.select("query_id", "chunk_id", F.lit(3).alias("tier"), (F.col("rank") - 1).cast("double").alias("k"), (0.8 - (F.col("rank") - 1) * 0.02).alias("score"))
        best = first.unionByName(second).unionByName(third).groupBy("query_id", "chunk_id").agg(F.min(F.struct("tier", "k", "score")).alias("x"))
        return _first(best, self.context, "x.tier", "x.k", "chunk_id", out="place").select("query_id", "place", "chunk_id", F.round("x.score", 6).alias("score"), F.col("x.tier").alias("tier"))
