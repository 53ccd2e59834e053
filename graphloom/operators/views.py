"""The engine's tables as views over the driver's tables, in Spark and, as the text of common table expressions, in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _vector(col: str = "embedding"):
    return F.transform(col, lambda x: x.cast("double"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def _lines(self) -> DataFrame:
        key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))
        return self.table("lineitem").withColumn("triple_id", key)

    @cached_property
    def tt(self) -> DataFrame:
        """Triples before cleaning, about products."""
        o, c, n, p = self.table("orders"), self.table("customer"), self.table("nation"), self.table("part")
        j = self._lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        obj = F.when(F.col("l_linenumber") % 7 == 0, "").when(F.col("l_linestatus") == "F", F.lower("c_mktsegment")).otherwise(F.col("n_name"))
        return j.select(
            "triple_id", F.col("o_custkey").cast("int").alias("text_id"), F.col("l_orderkey").cast("string").alias("chunk_id"),
            F.col("p_name").alias("subject_norm"), F.when(F.col("l_returnflag") == "A", "depends on").when(F.col("l_returnflag") == "N", "is part of").otherwise("returned from").alias("predicate_norm"),
            obj.alias("object_norm"), F.col("p_type").alias("subject_type"), F.lit("Concept").alias("object_type"),
        )

    @cached_property
    def tg(self) -> DataFrame:
        """Canonical triples between suppliers and parts."""
        pred = F.when(F.col("l_returnflag") == "A", "depends on").when(F.col("l_returnflag") == "N", "is").otherwise("returned from")
        return self._lines.select("triple_id", F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("s"), pred.alias("p"), F.concat(F.lit("part "), F.col("l_partkey")).alias("o"), F.col("l_orderkey").cast("string").alias("chunk_id"))

    @cached_property
    def files(self) -> DataFrame:
        g = self.table("documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("tradition"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("domains"))
        i = F.dense_rank().over(Window.orderBy("source")).cast("int")  # one row a source
        return g.select(i.alias("text_id"), F.concat(F.lit("Work "), i).alias("title"), F.col("source").alias("author_source"), "tradition", "domains")

    @cached_property
    def raw(self) -> DataFrame:
        d = self.table("documents")
        content = F.replace("text", F.lit("\n"), F.lit("\n\n"))
        return d.select(F.col("doc_id").alias("text_id"), content.alias("content"), F.length(content).cast("long").alias("char_count"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"))

    @cached_property
    def chunks(self) -> DataFrame:
        d = self.table("documents").join(self.files.select("text_id", F.col("author_source").alias("source")), "source")
        pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
        return d.select(F.col("doc_id").cast("string").alias("chunk_id"), "text_id", pos.cast("long").alias("position"), F.when(F.col("doc_id") % 10 == 0, "document").otherwise("local").alias("level"), F.col("text").alias("content"), F.greatest(F.lit(1), F.expr("n_chars div 4")).cast("long").alias("approx_tokens"), "doc_id")

    @cached_property
    def ec(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), _vector().alias("embedding"))

    @cached_property
    def nodes(self) -> DataFrame:
        n = self.tg.select(F.explode(F.array("s", "o")).alias("node_id")).distinct()
        return n.withColumn("k", F.split_part("node_id", F.lit(" "), F.lit(2)).cast("long"))

    @cached_property
    def ee(self) -> DataFrame:
        n_vec = F.broadcast(self.table("embeddings").agg(F.count("*").alias("n")))
        v = self.table("embeddings").select("vec_id", _vector().alias("embedding"))
        return self.nodes.filter("k % 11 != 0").join(n_vec).withColumn("vec_id", F.col("k") % F.col("n")).join(v, "vec_id").select(F.col("node_id").alias("entity"), "embedding")

    @cached_property
    def mem(self) -> DataFrame:
        return self.nodes.select((F.col("k") % 10).cast("int").alias("comm_id"), "node_id", F.lit(1.0).alias("weight"))

    @cached_property
    def comms(self) -> DataFrame:
        g = self.mem.groupBy("comm_id").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))
        v = self.table("embeddings").select(F.col("vec_id").cast("int").alias("comm_id"), _vector().alias("summary_embedding"))
        return g.join(v, "comm_id", "left").select("comm_id", F.lit(0).alias("level"), "node_ids", F.size("node_ids").alias("size"), F.when(F.col("comm_id") % 2 == 0, F.concat(F.lit("summary "), "comm_id")).alias("summary"), "summary_embedding", F.slice("node_ids", 1, 10).alias("top_terms"))

    @cached_property
    def reports(self) -> DataFrame:
        d = self.chunks.filter("doc_id % 10 <> 9").groupBy((F.col("doc_id") % 10).cast("int").alias("comm_id")).agg(F.array_sort(F.collect_list("chunk_id")).alias("cited"))
        v = self.table("embeddings").filter("vec_id between 10 and 19").select((F.col("vec_id") - 10).cast("int").alias("comm_id"), _vector().alias("report_embedding"))
        return v.join(d, "comm_id", "left").select("comm_id", F.concat(F.lit("report "), "comm_id").alias("report_text"), "report_embedding", F.coalesce("cited", F.expr("cast(array() as array<string>)")).alias("cited_chunk_ids"))

    @cached_property
    def qv(self) -> DataFrame:
        return self.table("embeddings").filter("vec_id = 0").select(_vector().alias("q"))

    @cached_property
    def msgs(self) -> DataFrame:
        return self.table("conversations")


SQL = r"""
lines as (select *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) as triple_id from lineitem),
tt as (
  select triple_id, o_custkey::int as text_id, l_orderkey::varchar as chunk_id, p_name as subject_norm,
         case l_returnflag when 'A' then 'depends on' when 'N' then 'is part of' else 'returned from' end as predicate_norm,
         case when l_linenumber % 7 = 0 then '' when l_linestatus = 'F' then lower(c_mktsegment) else n_name end as object_norm,
         p_type as subject_type, 'Concept' as object_type
  from lines join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey),
tg as (
  select triple_id, 'supplier ' || l_suppkey as s, case l_returnflag when 'A' then 'depends on' when 'N' then 'is' else 'returned from' end as p,
         'part ' || l_partkey as o, l_orderkey::varchar as chunk_id from lines),
files as (
  select dense_rank() over (order by source)::int as text_id, 'Work ' || dense_rank() over (order by source) as title, source as author_source, tradition, domains
  from (select source, arg_min(lang, doc_id) as tradition, array_to_string(list_sort(list(distinct lang)), ';') as domains from documents group by source)),
raw as (select doc_id as text_id, replace(text, chr(10), chr(10) || chr(10)) as content, length(replace(text, chr(10), chr(10) || chr(10)))::bigint as char_count, source || '/' || doc_id || '.txt' as file_path from documents),
chunks as (
  select doc_id::varchar as chunk_id, f.text_id, row_number() over (partition by source order by doc_id) as position,
         case when doc_id % 10 = 0 then 'document' else 'local' end as level, text as content, greatest(1, n_chars // 4)::bigint as approx_tokens, doc_id
  from documents d join files f on d.source = f.author_source),
ec as (select vec_id::varchar as chunk_id, embedding::double[] as embedding from embeddings),
nodes as (select node_id, split_part(node_id, ' ', 2)::bigint as k from (select s as node_id from tg union select o from tg)),
ee as (select node_id as entity, v.embedding::double[] as embedding from nodes join embeddings v on v.vec_id = k % (select count(*) from embeddings) where k % 11 <> 0),
mem as (select (k % 10)::int as comm_id, node_id, 1.0::double as weight from nodes),
comms as (
  select m.comm_id, 0 as level, m.node_ids, len(m.node_ids)::int as size, case when m.comm_id % 2 = 0 then 'summary ' || m.comm_id end as summary,
         v.embedding::double[] as summary_embedding, m.node_ids[1:10] as top_terms
  from (select comm_id, list(node_id order by node_id) as node_ids from mem group by comm_id) m left join embeddings v on v.vec_id = m.comm_id),
reports as (
  select (v.vec_id - 10)::int as comm_id, 'report ' || (v.vec_id - 10) as report_text, v.embedding::double[] as report_embedding, coalesce(c.cited, []::varchar[]) as cited_chunk_ids
  from embeddings v left join (select doc_id % 10 as comm_id, list(chunk_id order by chunk_id) as cited from chunks where doc_id % 10 <> 9 group by 1) c on c.comm_id = v.vec_id - 10
  where v.vec_id between 10 and 19),
qv as (select embedding::double[] as q from embeddings where vec_id = 0)
"""
