"""The offline run: files to chunks, triples, graph, communities and scores, stage by stage, each idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators import canonicalization, chunking, extraction, graph
from .operators import rules as R
from .operators.relational import best_per_pair, ends
from .operators.shared import discard, materialize
from .sources import files
from .sources.catalog import Catalog

CHUNK = "chunk_id string, text_id long, seq int, level string, start_char int, end_char int, approx_tokens int, content string"
STAGES = ("load", "chunk", "extract", "clean", "canonicalize", "graph", "communities", "conceptness", "embed")


class Pipeline:
    """judge: decides on doubtful pairs of entity names; make_extractor and make_embedder: models, built in each worker."""

    def __init__(self, catalog: Catalog, config: EngineConfig | None = None, judge: canonicalization.Judge | None = canonicalization.same_letters, make_extractor: Callable = extraction.OfflineExtractor, make_embedder: Callable = extraction.HashEmbedder, decoders: dict | None = None):
        self.c, self.config, self.judge = catalog, (config or EngineConfig()).clamped(), judge
        self.make_extractor, self.make_embedder, self.decoders = make_extractor, make_embedder, decoders

    def run(self, stages: tuple[str, ...] = STAGES, dry_run: bool = False) -> dict[str, int]:
        """Rows that each stage added or wrote; dry_run: what it would."""
        done: dict[str, int] = {}
        for s in stages:
            step: Callable[[bool], int] = getattr(self, f"_{s}")
            done[s] = step(dry_run)
        return done

    def _put(self, name: str, df: DataFrame, dry: bool, append: bool = False) -> int:
        """Rows of df, which is worked out once and, but for a dry run, becomes or extends the table."""
        if dry:
            return df.count()
        t = materialize(df, name)
        n = t.count()
        if append and n:
            self.c.append(name, t)
        elif not append:
            self.c.overwrite(name, t)
        discard(t)
        return n

    def _load(self, dry: bool) -> int:
        have = self.c.read("raw_texts", "text_id long, file_path string, content string, char_count long")
        found = files.listing(self.c.spark, self.config.resources_dir, tuple(self.config.formats)).withColumnRenamed("path", "file_path")
        new = found.join(have.select("file_path"), "file_path", "left_anti")
        if dry:
            return new.count()
        # an id once given stays, so new files get ids beside those in use
        meta = materialize(files.metadata(new.select("file_path"), taken=have.select("text_id")).select("file_path", F.col("text_id").cast("long").alias("text_id"), "title", "author", "ext"), "files")
        n = meta.count()
        if n:
            text = files.load_texts(new.select(F.col("file_path").alias("path"), "content"), self.decoders).withColumnRenamed("path", "file_path").join(meta, "file_path")
            self.c.append("raw_texts", text.select("text_id", "file_path", F.col("text").alias("content"), F.length("text").cast("long").alias("char_count")))
            self.c.append("files", meta)
        discard(meta)
        return n

    def _chunk(self, dry: bool) -> int:
        have = self.c.read("chunks", CHUNK)
        texts = self.c.read("raw_texts").join(have.select("text_id").distinct(), "text_id", "left_anti")
        cut = chunking.semantic_chunks if self.config.chunk_method == "semantic" else chunking.paragraph_chunks
        new = cut(texts, self.config.chunk_max_chars, self.config.chunk_overlap)
        new = new.withColumn("chunk_id", F.format_string("%d_%s%04d", "text_id", F.substring("level", 1, 1), "seq"))
        return self._put("chunks", new.select(*have.columns), dry, append=True)

    def _extract(self, dry: bool) -> int:
        done = self.c.read("extracted", extraction.EXTRACTED).select("chunk_id").distinct()
        pending = self.c.read("chunks").filter("level = 'local'").join(done, "chunk_id", "left_anti")
        n = pending.count()
        if n and not dry:
            self.c.append("extracted", extraction.extract(pending, self.make_extractor))
        return n

    def _clean(self, dry: bool) -> int:
        k = self.config
        t = self.c.read("extracted").filter("kind = 'triple'").select(F.concat_ws("-", "chunk_id", "n").alias("triple_id"), "chunk_id", F.col("subject").alias("subject_norm"), F.col("predicate").alias("predicate_norm"), F.col("object").alias("object_norm"), F.lit("Concept").alias("subject_type"), F.lit("Concept").alias("object_type"))
        kept = t.filter(R.alpha() & ~R.noise(k.noise_entities, k.noise_predicates, k.failed_entities, k.type_rules))
        out = best_per_pair(kept, "subject_norm", "predicate_norm", "object_norm", "triple_id")
        return self._put("clean_triples", out.select("triple_id", "chunk_id", F.col("subject_norm").alias("s"), F.col("predicate_norm").alias("p"), F.col("object_norm").alias("o")), dry)

    def _canonicalize(self, dry: bool) -> int:
        k = self.config
        t, names, preds = canonicalization.canonicalize_all(self.c.read("clean_triples"), k.entity_threshold, k.predicate_threshold, self.judge, make=self.make_embedder)
        if not dry:
            self.c.overwrite("entity_canon_map", names)
            self.c.overwrite("predicate_canon_map", preds)
        return self._put("triples", t, dry)

    def _graph(self, dry: bool) -> int:
        return self._put("edges", graph.directed_edges(self.c.read("triples")), dry)

    def _communities(self, dry: bool) -> int:
        e = graph.clustering_edges(graph.pair_edges(self.c.read("triples")), self.config.min_edge_weight, 0.0)
        return self._put("community_membership", graph.communities(e, self.config.resolution), dry)

    def _conceptness(self, dry: bool) -> int:
        t = self.c.read("triples")
        names = ends(t).groupBy("entity").agg(F.count("*").alias("mentions"))
        vectors = extraction.embed(names.select("entity"), "entity", "entity", self.make_embedder)
        return self._put("entity_conceptness", graph.conceptness(self.c.read("edges"), names, vectors), dry)

    def _embed(self, dry: bool) -> int:
        have = self.c.read("embedded_chunks", "chunk_id string, embedding array<double>")
        new = self.c.read("chunks").join(have.select("chunk_id"), "chunk_id", "left_anti")
        n = new.count()
        if n and not dry:
            self.c.append("embedded_chunks", extraction.embed(new.select("chunk_id", "content"), "chunk_id", "content", self.make_embedder, batch=self.config.embedding_batch))
        return n
