"""Joins, aggregates, windows, top-k and set operations over the engine's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rules as R
from ..operators.relational import best_per_pair, by_ids, either_end, ends, global_rank, upsert
from .registry import query

L = lambda c: F.col(c).cast("long")
HAS_O = "o is not null and o <> ''"


# --- scans, sinks -----------------------------------------------------------------------------------------------------
@query("sc3_resource_metadata", r"""
select file_path, case when regexp_matches(stem, '^[0-9]+(_|$)') then split_part(stem, '_', 1)::int + 1 else (row_number() over (order by file_path))::int end as text_id,
       ext, title from (
  select file_path, regexp_replace(split_part(file_path, '/', -1), '\.[^.]*$', '') as stem, '.txt' as ext, replace(regexp_replace(split_part(file_path, '/', -1), '\.[^.]*$', ''), '_', ' ') as title from raw)""")
def _(v):
    from ..sources.files import metadata

    return metadata(v.raw.select("file_path")).select("file_path", "text_id", "ext", "title")


@query("sc8_load_skip_existing", "select file_path, text_id::bigint as text_id, char_count from raw where text_id % 3 <> 0")
def _(v):
    have = v.raw.filter("text_id % 3 = 0").select("file_path")
    return v.raw.join(have, "file_path", "left_anti").select("file_path", "text_id", "char_count")


@query("sc9_chunks_by_ids", "select chunk_id, text_id, content from chunks where chunk_id in ('1', '5', '17', '250', '999')")
def _(v):
    return by_ids(v.chunks, "chunk_id", ["1", "5", "17", "250", "999"]).select("chunk_id", "text_id", "content")


@query("sc10_full_scans", "select comm_id, level, size, summary from comms")
def _(v):
    return v.comms.select("comm_id", "level", "size", "summary")


@query("sc11_typed_empty", "select chunk_id, text_id, content from chunks where 1 = 0")
def _(v):
    return v.chunks.select("chunk_id", "text_id", "content").limit(0)


@query("sc12_table_counts", "select 'documents' as name, count(*) as n from documents union all select 'lineitem', count(*) from lineitem union all select 'embeddings', count(*) from embeddings")
def _(v):
    one = lambda t: v.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("documents").unionByName(one("lineitem")).unionByName(one("embeddings"))


@query("sk2_upsert", "select chunk_id, text_id, case when doc_id % 4 = 0 then 'new ' || chunk_id else content end as content from chunks where doc_id % 2 = 0 or doc_id % 4 = 0")
def _(v):
    old = v.chunks.filter("doc_id % 2 = 0").select("chunk_id", "text_id", "content")
    new = v.chunks.filter("doc_id % 4 = 0").select("chunk_id", "text_id", F.concat(F.lit("new "), "chunk_id").alias("content"), F.lit(2).alias("seq"))
    stale = new.withColumn("content", F.lit("stale")).withColumn("seq", F.lit(1))
    return upsert(old, new.unionByName(stale), ["chunk_id"], "seq")


@query("sk6_map_lookup_update", "select triple_id, case p when 'is' then 'be' when 'depends on' then 'requires' end as p_canon, case when k % 3 = 0 then 'canon ' || s else s end as s_canon from tg join nodes on s = node_id")
def _(v):
    pm = v.spark.createDataFrame([("is", "be"), ("depends on", "requires")], "p string, p_canon string")
    sm = v.nodes.filter("k % 3 = 0").select(F.col("node_id").alias("s"), F.concat(F.lit("canon "), "node_id").alias("c"))
    return v.tg.join(F.broadcast(pm), "p", "left").join(sm, "s", "left").select("triple_id", "p_canon", F.coalesce("c", "s").alias("s_canon"))


# --- joins ------------------------------------------------------------------------------------------------------------
@query("jo1_files_texts", "select r.text_id, f.title, r.char_count from raw r join documents d on r.text_id = d.doc_id join files f on f.author_source = d.source")
def _(v):
    d = v.table("documents").select(F.col("doc_id").alias("text_id"), "source")
    return v.raw.join(d, "text_id").join(v.files.withColumnRenamed("text_id", "f"), F.col("source") == F.col("author_source")).select("text_id", "title", "char_count")


@query("jo2_texts_without_chunks", "select text_id, file_path from raw where text_id not in (select doc_id from chunks where doc_id % 5 <> 0)")
def _(v):
    return v.raw.join(v.chunks.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("text_id")), "text_id", "left_anti").select("text_id", "file_path")


@query("jo3_chunks_without_embedding", "select c.chunk_id, c.text_id from chunks c left join ec e using (chunk_id) where e.chunk_id is null")
def _(v):
    return v.chunks.join(v.ec, "chunk_id", "left_anti").select("chunk_id", "text_id")


@query("jo4_entities_without_embedding", "select node_id from nodes where node_id not in (select entity from ee)")
def _(v):
    return v.nodes.select("node_id").join(v.ee.select(F.col("entity").alias("node_id")), "node_id", "left_anti")


@query("jo5_pending_chunks", "select chunk_id, level from chunks where level in ('local') and chunk_id not in (select chunk_id from tg) and chunk_id not in (select chunk_id from chunks where doc_id % 7 = 0) order by chunk_id limit 200")
def _(v):
    c = v.chunks.filter(F.col("level").isin("local"))
    c = c.join(v.tg.select("chunk_id"), "chunk_id", "left_anti").join(v.chunks.filter("doc_id % 7 = 0").select("chunk_id"), "chunk_id", "left_anti")
    return c.select("chunk_id", "level").orderBy("chunk_id").limit(200)


@query("jo6_chunk_provenance", "select c.chunk_id, c.position, f.title, nullif(f.author_source, 'src7') as author from chunks c left join (select * from files where text_id <> 4) f on c.text_id = f.text_id")
def _(v):
    f = v.files.filter("text_id <> 4").select("text_id", "title", F.nullif("author_source", F.lit("src7")).alias("author"))
    return v.chunks.join(f, "text_id", "left").select("chunk_id", "position", "title", "author")


@query("jo8_predicate_support", "select t.triple_id, n.support from tt t join (select subject_norm, predicate_norm, object_norm, count(*) as support from tt where object_norm <> '' group by all) n using (subject_norm, predicate_norm, object_norm)")
def _(v):
    w = Window.partitionBy("subject_norm", "object_norm", "predicate_norm")
    return v.tt.filter("object_norm <> ''").select("triple_id", F.count("*").over(w).alias("support"))


@query("jo9_canonical_ids", "select triple_id, coalesce(a.c, s) as s_canon, coalesce(b.c, o) as o_canon from tg left join (select node_id, 'e' || k as c from nodes where k % 2 = 0) a on s = a.node_id left join (select node_id, 'e' || k as c from nodes where k % 2 = 0) b on o = b.node_id")
def _(v):
    m = v.nodes.filter("k % 2 = 0").select("node_id", F.concat(F.lit("e"), "k").alias("c"))
    return v.tg.join(m.toDF("s", "a"), "s", "left").join(m.toDF("o", "b"), "o", "left").select("triple_id", F.coalesce("a", "s").alias("s_canon"), F.coalesce("b", "o").alias("o_canon"))


@query("jo10_named_flags", "select 'e' || (k % 50) as canon, max(case when k % 7 = 0 then 1 else 0 end)::int = 1 as named from nodes group by 1")
def _(v):
    ner = v.nodes.filter("k % 7 = 0").select("node_id", F.lit(True).alias("flag"))
    j = v.nodes.join(ner, "node_id", "left").groupBy(F.concat(F.lit("e"), (F.col("k") % 50)).alias("canon"))
    return j.agg(F.coalesce(F.bool_or("flag"), F.lit(False)).alias("named"))


@query("jo11_chunks_of_communities", "select distinct t.chunk_id from tg t join mem m on t.s = m.node_id or t.o = m.node_id where m.comm_id in (1, 4)")
def _(v):
    return either_end(v.tg, v.mem.filter(F.col("comm_id").isin(1, 4)).select("node_id")).select("chunk_id").distinct()


@query("jo13_sources_with_counts", "select title, author_source, count(distinct chunk_id) as n_chunks from files join chunks using (text_id) group by 1, 2")
def _(v):
    return v.files.join(v.chunks, "text_id").groupBy("title", "author_source").agg(F.count_distinct("chunk_id").alias("n_chunks"))


#: The reference's limit on a scan.
SCAN = 50_000


@query("jo14_provenance_scan", f"select e.node_id, c.chunk_id from (select s as node_id, chunk_id from tg) e join chunks c using (chunk_id) order by 1, 2 limit {SCAN}")
def _(v):
    return v.tg.select(F.col("s").alias("node_id"), "chunk_id").join(v.chunks.select("chunk_id"), "chunk_id").select("node_id", "chunk_id").orderBy("node_id", "chunk_id").limit(SCAN)


@query("jo15_communities_reports", "select c.comm_id, c.size, r.report_text, array_to_string(c.top_terms, ',') as terms from comms c left join reports r using (comm_id)")
def _(v):
    return v.comms.join(v.reports.select("comm_id", "report_text"), "comm_id", "left").select("comm_id", "size", "report_text", F.array_join(F.slice("top_terms", 1, 10), ",").alias("terms"))


@query("jo16_entity_community", "select node_id, comm_id from nodes left join (select node_id, comm_id from mem where comm_id <> 3) using (node_id)")
def _(v):
    return v.nodes.select("node_id").join(v.mem.filter("comm_id <> 3").select("node_id", "comm_id"), "node_id", "left")


@query("jo17_edges_in_scope", "select distinct a.s, a.p, a.o from tg a where exists (select 1 from tg b join chunks c using (chunk_id) where (b.s, b.p, b.o) = (a.s, a.p, a.o) or (b.o, b.p, b.s) = (a.s, a.p, a.o))")
def _(v):
    scoped = v.tg.join(v.chunks.select("chunk_id"), "chunk_id", "left_semi").select("s", "p", "o").distinct()
    both = scoped.unionByName(scoped.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))).distinct()
    return v.tg.select("s", "p", "o").distinct().join(both, ["s", "p", "o"], "left_semi")


@query("jo18_nodes_of_scoped_edges", "select node_id from nodes where node_id in (select s from tg join chunks using (chunk_id) union select o from tg join chunks using (chunk_id))")
def _(v):
    scoped = ends(v.tg.join(v.chunks.select("chunk_id"), "chunk_id", "left_semi"), out="node_id").distinct()
    return v.nodes.select("node_id").join(scoped, "node_id", "left_semi")


@query("jo19_two_hop", "select distinct b.o as node_id from (select distinct o from tg where s = 'supplier 1') a join tg c on c.o = a.o join tg b on b.s = c.s")
def _(v):
    e = v.tg.select("s", "o").distinct()
    hop1 = e.filter("s = 'supplier 1'").select("o")
    back = e.join(hop1, "o", "left_semi").select("s").distinct()
    return e.join(back, "s", "left_semi").select(F.col("o").alias("node_id")).distinct()


@query("jo22_chunk_entities", "select chunk_id, array_to_string(list_sort(list(distinct e)), ',') as entities from (select chunk_id, s as e from tg union all select chunk_id, o from tg) group by 1")
def _(v):
    return ends(v.tg, "s", "o", "e", "chunk_id").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("e")), ",").alias("entities"))


# --- aggregates -------------------------------------------------------------------------------------------------------
@query("ag1_directed_edges", f"select s, p, o, count(distinct chunk_id) as weight, array_to_string(list_sort(list(distinct chunk_id)), ',') as chunks from tg where {HAS_O} group by 1, 2, 3")
def _(v):
    return v.tg.filter(HAS_O).groupBy("s", "p", "o").agg(F.count_distinct("chunk_id").alias("weight"), F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("chunks"))


@query("ag2_pair_edges", f"select least(s, o) as u_id, greatest(s, o) as v_id, count(distinct chunk_id) as weight, count(distinct p) as predicate_count, array_to_string(list_sort(list(distinct p))[1:5], ',') as top_predicates from tg where {HAS_O} and s <> o group by 1, 2")
def _(v):
    g = v.tg.filter(f"{HAS_O} and s <> o").groupBy(F.least("s", "o").alias("u_id"), F.greatest("s", "o").alias("v_id"))
    sets = g.agg(F.collect_set("chunk_id").alias("c"), F.array_sort(F.collect_set("p")).alias("ps"))
    return sets.select("u_id", "v_id", F.size("c").cast("long").alias("weight"), F.size("ps").cast("long").alias("predicate_count"), F.array_join(F.slice("ps", 1, 5), ",").alias("top_predicates"))


@query("ag3_pair_predicates", "select p, count(distinct chunk_id) as n from tg where (s = 'supplier 1' and o = 'part 1') or (s in ('supplier 1', 'supplier 2') and k > 0) group by p".replace("and k > 0", "and o like 'part 1%'"))
def _(v):
    c = ((F.col("s") == "supplier 1") & (F.col("o") == "part 1")) | (F.col("s").isin("supplier 1", "supplier 2") & F.col("o").like("part 1%"))
    return v.tg.filter(c).groupBy("p").agg(F.count_distinct("chunk_id").alias("n"))


@query("ag4_mention_counts", "select entity, sum(n)::bigint as mentions from (select s as entity, count(*) as n from tg group by 1 union all select o, count(*) from tg group by 1) group by 1")
def _(v):
    return ends(v.tg).groupBy("entity").agg(F.count("*").alias("mentions"))


@query("ag5_frequent_entities", "select entity, count(*) as n from (select s as entity from tg union all select o from tg) group by 1 having count(*) >= 2 order by n desc, entity limit 500")
def _(v):
    return ends(v.tg).groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "entity").limit(500)


@query("ag6_predicate_counts", "select p, count(*) as n from tg group by 1")
def _(v):
    return v.tg.groupBy("p").agg(F.count("*").alias("n"))


@query("ag7_entity_types", "select subject_norm as entity_norm, subject_type as entity_type, null::varchar as subtype, count(*) as mention_count from tt group by 1, 2")
def _(v):
    return v.tt.groupBy(F.col("subject_norm").alias("entity_norm"), F.col("subject_type").alias("entity_type")).agg(F.count("*").alias("mention_count")).withColumn("subtype", F.lit(None).cast("string"))


@query("ag8_pairs_with_predicates", "select count(*) as pairs, count(*) filter (n > 1) as several from (select subject_norm, object_norm, count(distinct predicate_norm) as n from tt where object_norm <> '' group by 1, 2)")
def _(v):
    return v.tt.filter("object_norm <> ''").groupBy("subject_norm", "object_norm").agg(F.count_distinct("predicate_norm").alias("n")).agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("several"))


@query("ag9_weight_histogram", "select weight, count(*) as pairs from (select least(s, o) u, greatest(s, o) w, count(distinct chunk_id) as weight from tg where s <> o group by 1, 2) group by 1")
def _(v):
    return v.tg.filter("s <> o").groupBy(F.least("s", "o"), F.greatest("s", "o")).agg(F.count_distinct("chunk_id").alias("weight")).groupBy("weight").agg(F.count("*").alias("pairs"))


@query("ag10_summary_stats", "select count(*) as n, round(avg(char_count), 6) as mean, min(char_count) as low, max(char_count) as high, round(percentile_cont(0.25) within group (order by char_count), 6)::double as p25, round(percentile_cont(0.5) within group (order by char_count), 6)::double as p50, round(percentile_cont(0.75) within group (order by char_count), 6)::double as p75 from raw")
def _(v):
    p = F.percentile("char_count", [0.25, 0.5, 0.75])
    return v.raw.agg(F.count("*").alias("n"), F.round(F.avg("char_count"), 6).alias("mean"), F.min("char_count").alias("low"), F.max("char_count").alias("high"), p.alias("p")).select("n", "mean", "low", "high", *(F.round(F.get("p", i), 6).alias(a) for i, a in enumerate(("p25", "p50", "p75"))))


@query("ag11_percentile_threshold", "select chunk_id, approx_tokens from chunks where approx_tokens >= (select percentile_cont(0.3) within group (order by approx_tokens) from chunks)")
def _(v):
    t = v.chunks.agg(F.percentile("approx_tokens", 0.3).alias("t"))
    return v.chunks.join(F.broadcast(t), F.col("approx_tokens") >= F.col("t")).select("chunk_id", "approx_tokens")


@query("ag12_community_stats", "select count(*) as n, sum(size)::bigint as nodes, round(avg(size), 6) as mean, round(median(size), 6)::double as med, max(size) as high, min(size) as low, count(summary) as summaries from comms")
def _(v):
    return v.comms.agg(F.count("*").alias("n"), F.sum("size").alias("nodes"), F.round(F.avg("size"), 6).alias("mean"), F.round(F.median("size"), 6).alias("med"), F.max("size").alias("high"), F.min("size").alias("low"), F.count("summary").alias("summaries"))


@query("ag13_top_subjects", "select subject_norm, count(*) as n from tt group by 1 order by n desc, subject_norm limit 25")
def _(v):
    return v.tt.groupBy("subject_norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_norm").limit(25)


_PROBES = ["%green%", "%blue%", "%auto%", "%a%e%", "%zzz%"]


@query("ag14_pattern_probes", "select pattern, count(*) filter (lower(subject_norm) like pattern or lower(object_norm) like pattern) as hits from tt, (select unnest(['%green%', '%blue%', '%auto%', '%a%e%', '%zzz%']) as pattern) group by 1")
def _(v):
    hit = lambda w: F.count_if(F.lower("subject_norm").like(w) | F.lower("object_norm").like(w))
    one = v.tt.agg(F.array(*(F.struct(F.lit(w).alias("pattern"), hit(w).alias("hits")) for w in _PROBES)).alias("a"))
    return one.select(F.explode("a").alias("a")).select("a.*")


@query("ag15_distinct_samples", "select distinct subject_norm from tt where lower(subject_norm) like '%a%' order by 1 limit 20")
def _(v):
    return v.tt.filter(F.lower("subject_norm").like("%a%")).select("subject_norm").distinct().orderBy("subject_norm").limit(20)


@query("ag16_corpus_profile", r"""select count(*) as n, min(char_count) as low, max(char_count) as high, floor(avg(char_count))::bigint as mean, min(np) as p_low, max(np) as p_high, round(avg(np), 2) as p_mean
from (select char_count, len(list_filter(string_split(content, chr(10) || chr(10)), lambda x: trim(x) <> ''))::bigint as np from raw)""")
def _(v):
    n = F.size(F.filter(F.split("content", "\n\n"), lambda x: F.trim(x) != "")).cast("long")
    return v.raw.select("char_count", n.alias("np")).agg(F.count("*").alias("n"), F.min("char_count").alias("low"), F.max("char_count").alias("high"), F.floor(F.avg("char_count")).alias("mean"), F.min("np").alias("p_low"), F.max("np").alias("p_high"), F.round(F.avg("np"), 2).alias("p_mean"))


@query("ag17_filtered_array", "select comm_id, coalesce(array_to_string(list_sort(list(summary) filter (summary is not null)), ','), '') as found from comms group by 1")
def _(v):
    return v.comms.groupBy("comm_id").agg(F.array_join(F.array_sort(F.collect_list("summary")), ",").alias("found"))


@query("ag18_domain_counts", "select trim(d) as domain, count(*) as n from (select unnest(string_split(domains, ';')) as d from files) group by 1")
def _(v):
    return v.files.select(F.explode(F.split("domains", ";")).alias("d")).groupBy(F.trim("d").alias("domain")).agg(F.count("*").alias("n"))


@query("ag19_failure_rate", "select s, count(*) as total, count(*) filter (k % 2 = 0) as failed from tg join nodes on o = node_id group by 1 having count(*) >= 2 and count(*) filter (k % 2 = 0) / count(*) > 0.5")
def _(v):
    return v.tg.withColumn("k", F.split_part("o", F.lit(" "), F.lit(2)).cast("long")).groupBy("s").agg(F.count("*").alias("total"), F.count_if(F.col("k") % 2 == 0).alias("failed")).filter("total >= 2 and failed / total > 0.5")


@query("ag20_degree", "select node_id, count(*) as degree, sum(w)::bigint as weighted from (select s as node_id, w from e union all select o, w from e) group by 1".replace("from e", "from (select s, p, o, count(distinct chunk_id) as w from tg group by 1, 2, 3)"))
def _(v):
    e = v.tg.groupBy("s", "p", "o").agg(F.count_distinct("chunk_id").alias("w"))
    return ends(e, "s", "o", "node_id", "w").groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted"))


@query("ag21_community_overlap", "select comm_id, count(*) as n from (select s as node_id from tg join chunks using (chunk_id) union select o from tg join chunks using (chunk_id)) join mem using (node_id) group by 1 order by n desc, comm_id limit 5")
def _(v):
    n = ends(v.tg.join(v.chunks.select("chunk_id"), "chunk_id", "left_semi"), out="node_id").distinct()
    return n.join(v.mem, "node_id").groupBy("comm_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comm_id").limit(5)


@query("ag22_size_classes", "select count(*) filter (size > 10) as over10, count(*) filter (size > 50) as over50, count(*) filter (size > 100) as over100, round(100.0 * sum(size) / (select count(*) from nodes), 6)::double as coverage from comms")
def _(v):
    n = F.broadcast(v.nodes.agg(F.count("*").alias("n")))
    c = v.comms.agg(*(F.count_if(F.col("size") > k).alias(f"over{k}") for k in (10, 50, 100)), F.sum("size").alias("covered"))
    return c.join(n).select("over10", "over50", "over100", F.round(100.0 * F.col("covered") / F.col("n"), 6).alias("coverage"))


@query("ag24_canonical_rollup", "select case when k % 2 = 0 then 'e' || k else node_id end as canon, sum(n)::bigint as n from (select s, count(*) as n from tg group by 1) join nodes on s = node_id group by 1")
def _(v):
    m = v.nodes.select("node_id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("e"), "k")).otherwise(F.col("node_id")).alias("canon"))
    return v.tg.groupBy(F.col("s").alias("node_id")).agg(F.count("*").alias("c")).join(m, "node_id").groupBy("canon").agg(F.sum("c").alias("n"))


@query("ag26_merge_statistics", "select count(distinct node_id) as before, count(distinct k % 100) as after, round(100.0 * (count(distinct node_id) - count(distinct k % 100)) / count(distinct node_id), 6)::double as merged from nodes")
def _(v):
    a = v.nodes.agg(F.count_distinct("node_id").alias("before"), F.count_distinct(F.col("k") % 100).alias("after"))
    return a.withColumn("merged", F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 6))


# --- windows ----------------------------------------------------------------------------------------------------------
_BEST = "select {c} from (select *, row_number() over (partition by {s}, {o} order by sup desc, {p}, triple_id) as r from (select *, count(*) over (partition by {s}, {o}, {p}) as sup from {t})) where r = 1 or {o} is null or {o} = ''"


@query("wn1_best_predicate_row", _BEST.format(c="triple_id, subject_norm, predicate_norm, object_norm", s="subject_norm", p="predicate_norm", o="object_norm", t="tt"))
def _(v):
    return best_per_pair(v.tt, "subject_norm", "predicate_norm", "object_norm", "triple_id").select("triple_id", "subject_norm", "predicate_norm", "object_norm")


@query("wn2_best_predicate_canonical", _BEST.format(c="triple_id, s, p, o", s="s", p="p", o="o", t="tg"))
def _(v):
    return best_per_pair(v.tg, "s", "p", "o", "triple_id").select("triple_id", "s", "p", "o")


@query("wn2b_best_predicate_all_rows", "select triple_id, s, p, o from (select *, dense_rank() over (partition by s, o order by sup desc, p) as r from (select *, count(*) over (partition by s, o, p) as sup from tg)) where r = 1 or o is null or o = ''")
def _(v):
    return best_per_pair(v.tg, "s", "p", "o", "triple_id", mode="predicate").select("triple_id", "s", "p", "o")


@query("wn3_chunk_numbers", "select chunk_id, printf('%d_%s%04d', text_id, level[1], row_number() over (partition by text_id, level order by doc_id)) as number, case when level = 'local' then row_number() over (partition by text_id, level order by doc_id) end as place from chunks")
def _(v):
    n = F.row_number().over(Window.partitionBy("text_id", "level").orderBy("doc_id"))
    return v.chunks.select("chunk_id", F.format_string("%d_%s%04d", F.col("text_id"), F.substring("level", 1, 1), n).alias("number"), F.when(F.col("level") == "local", n.cast("long")).alias("place"))


_E = "select s, o, count(*) as w from tg group by 1, 2"


@query("wn4_top_neighbours", f"select s, o, w from (select *, row_number() over (partition by s order by w desc, o) as r from ({_E})) where r <= 10")
def _(v):
    e = v.tg.groupBy("s", "o").agg(F.count("*").alias("w"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("w"), "o"))).filter("r <= 10").drop("r")


@query("wn5_top_nodes", f"select comm_id, node_id, d from (select comm_id, node_id, d, row_number() over (partition by comm_id order by d desc, node_id) as r from (select node_id, sum(w)::bigint as d from (select s as node_id, w from ({_E}) union all select o, w from ({_E})) group by 1) join mem using (node_id)) where r <= 15")
def _(v):
    d = ends(v.tg.select("s", "o"), out="node_id").groupBy("node_id").agg(F.count("*").alias("d"))
    r = F.row_number().over(Window.partitionBy("comm_id").orderBy(F.desc("d"), "node_id"))
    return d.join(v.mem, "node_id").withColumn("r", r).filter("r <= 15").select("comm_id", "node_id", "d")


@query("wn6_top_edges", f"select comm_id, s, o, w from (select a.comm_id, s, o, w, row_number() over (partition by a.comm_id order by w desc, s, o) as r from ({_E}) e join mem a on a.node_id = s join mem b on b.node_id = o and a.comm_id = b.comm_id) where r <= 20")
def _(v):
    e = v.tg.groupBy("s", "o").agg(F.count("*").alias("w"))
    a, b = v.mem.select(F.col("node_id").alias("s"), "comm_id"), v.mem.select(F.col("node_id").alias("o"), "comm_id")
    r = F.row_number().over(Window.partitionBy("comm_id").orderBy(F.desc("w"), "s", "o"))
    return e.join(a, "s").join(b, ["o", "comm_id"]).withColumn("r", r).filter("r <= 20").select("comm_id", "s", "o", "w")


@query("wn7_first_position", "select chunk_id, min(position) as step from (select chunk_id, position from chunks union all select chunk_id, position + 5 from chunks) group by 1")
def _(v):
    p = v.chunks.select("chunk_id", "position")
    return p.unionByName(p.withColumn("position", F.col("position") + 5)).groupBy("chunk_id").agg(F.min("position").alias("step"))


@query("wn8_last_five", "select conv_id, turn, count(*) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding) as seen, coalesce(string_agg(role, ',') over (partition by conv_id order by turn rows between 5 preceding and 1 preceding), '') as roles from conversations")
def _(v):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    return v.msgs.select("conv_id", "turn", F.count("*").over(w).alias("seen"), F.array_join(F.collect_list("role").over(w), ",").alias("roles"))


@query("wn9_first_appearance_index", "select role, row_number() over (order by first_at, role) as idx from (select role, min(conv_id * 1000 + turn) as first_at from conversations group by 1)")
def _(v):
    g = v.msgs.groupBy("role").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_at"))
    return g.select("role", F.row_number().over(Window.orderBy("first_at", "role")).cast("long").alias("idx"))  # one row a key


# --- top-k ------------------------------------------------------------------------------------------------------------
@query("tk6_largest_communities", "select comm_id, size from comms order by size desc, comm_id limit 3")
def _(v):
    return v.comms.select("comm_id", "size").orderBy(F.desc("size"), "comm_id").limit(3)


@query("tk8_pair_truncation", f"select s, o, w from ({_E}) order by w desc, s, o limit 500")
def _(v):
    return v.tg.groupBy("s", "o").agg(F.count("*").alias("w")).orderBy(F.desc("w"), "s", "o").limit(500)


@query("tk10_seeds_by_degree", f"select node_id, d from (select node_id, count(*) as d from (select s as node_id from tg union all select o from tg) group by 1) join mem using (node_id) where comm_id in (2, 5) order by d desc, node_id limit 20")
def _(v):
    d = ends(v.tg, out="node_id").groupBy("node_id").agg(F.count("*").alias("d"))
    return d.join(v.mem.filter(F.col("comm_id").isin(2, 5)), "node_id", "left_semi").orderBy(F.desc("d"), "node_id").limit(20)


@query("tk13_ordered_preview", "select triple_id, subject_norm from tt order by triple_id limit 10")
def _(v):
    return v.tt.select("triple_id", "subject_norm").orderBy("triple_id").limit(10)


@query("tk14_point_lookup", "select comm_id from mem where node_id = 'supplier 7' limit 1")
def _(v):
    return v.mem.filter("node_id = 'supplier 7'").select("comm_id").limit(1)


# --- sets -------------------------------------------------------------------------------------------------------------
@query("so1_entities_of_chunks", "select s as entity from tg where chunk_id in ('1', '2', '3', '7') union select o from tg where chunk_id in ('1', '2', '3', '7')")
def _(v):
    return ends(by_ids(v.tg, "chunk_id", ["1", "2", "3", "7"])).filter("entity is not null and entity <> ''").distinct()


@query("so2_scoped_entities", f"select s as entity from tg join chunks using (chunk_id) where text_id in (1, 4) and {HAS_O} union select o from tg join chunks using (chunk_id) where text_id in (1, 4) and {HAS_O}")
def _(v):
    scope = v.chunks.filter(F.col("text_id").isin(1, 4)).select("chunk_id")
    return ends(v.tg.filter(HAS_O).join(scope, "chunk_id", "left_semi")).distinct()


@query("so3_union_all", "select s as entity, 'subject' as role from tg union all select o, 'object' from tg")
def _(v):
    return v.tg.select(F.explode(F.array(F.struct(F.col("s").alias("entity"), F.lit("subject").alias("role")), F.struct(F.col("o").alias("entity"), F.lit("object").alias("role")))).alias("x")).select("x.*")


@query("so4_scoped_edges", "select distinct s, o, p from tg join chunks using (chunk_id) where text_id in (1, 4)")
def _(v):
    return v.tg.join(v.chunks.filter(F.col("text_id").isin(1, 4)).select("chunk_id"), "chunk_id", "left_semi").select("s", "o", "p").distinct()


@query("so5_ordered_concat", "select chunk_id, row_number() over (order by k) as place from (select chunk_id, min(k) as k from (select chunk_id, doc_id as k from chunks where doc_id % 3 = 0 union all select chunk_id, 1000000000 + doc_id from chunks where doc_id % 2 = 0) group by 1)")
def _(v):
    a = v.chunks.filter("doc_id % 3 = 0").select("chunk_id", F.lit(0).alias("list"), "doc_id")
    b = v.chunks.filter("doc_id % 2 = 0").select("chunk_id", F.lit(1).alias("list"), "doc_id")
    first = a.unionByName(b).groupBy("chunk_id").agg(F.min(F.struct("list", "doc_id")).alias("at"))
    return global_rank(first, ["at"], "place").select("chunk_id", "place")


@query("so6_leakage", "select count(*) as leaked from (select chunk_id from chunks where text_id in (1, 4, 5) except all select chunk_id from chunks where text_id in (1, 4))")
def _(v):
    return v.chunks.filter(F.col("text_id").isin(1, 4, 5)).join(v.chunks.filter(F.col("text_id").isin(1, 4)).select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("leaked"))


@query("so7_shared_chunks", "select a.s, b.s as other, len(list_intersect(a.c, b.c))::int as shared from (select s, list(distinct chunk_id) c from tg where s in ('supplier 1', 'supplier 2', 'supplier 3') group by 1) a join (select s, list(distinct chunk_id) c from tg where s in ('supplier 1', 'supplier 2', 'supplier 3') group by 1) b on a.s < b.s")
def _(v):
    g = by_ids(v.tg, "s", ["supplier 1", "supplier 2", "supplier 3"]).groupBy("s").agg(F.collect_set("chunk_id").alias("c"))
    return g.join(g.toDF("other", "d"), F.col("s") < F.col("other")).select("s", "other", F.size(F.array_intersect("c", "d")).alias("shared"))


@query("so8_unclustered", "select node_id, coalesce(comm_id, -1)::int as comm_id from nodes left join (select * from mem where comm_id < 6) using (node_id)")
def _(v):
    return v.nodes.select("node_id").join(v.mem.filter("comm_id < 6").select("node_id", "comm_id"), "node_id", "left").select("node_id", F.coalesce("comm_id", F.lit(-1)).alias("comm_id"))


# --- cleaning end to end ----------------------------------------------------------------------------------------------
_ALPHA = "(regexp_full_match(subject_norm, '[A-Za-z][A-Za-z \\-]*') and regexp_full_match(predicate_norm, '[A-Za-z][A-Za-z \\-]*') and (object_norm is null or object_norm = '' or regexp_full_match(object_norm, '[A-Za-z][A-Za-z \\-]*')) and length(trim(subject_norm)) > 1 and (object_norm is null or object_norm = '' or length(trim(object_norm)) > 1))"
_NOISE = "(lower(subject_norm) like '%antique%' or lower(object_norm) like '%antique%' or lower(subject_norm) like '%mach%' or lower(object_norm) like '%mach%')"


@query("cl2_clean_triples", f"select triple_id, subject_norm, predicate_norm, object_norm from (select *, row_number() over (partition by subject_norm, object_norm order by sup desc, predicate_norm, triple_id) as r from (select *, count(*) over (partition by subject_norm, object_norm, predicate_norm) as sup from tt where {_ALPHA} and not {_NOISE})) where r = 1 or object_norm is null or object_norm = ''")
def _(v):
    kept = v.tt.filter(R.alpha() & ~R.noise(["%antique%", "%mach%"]))
    return best_per_pair(kept, "subject_norm", "predicate_norm", "object_norm", "triple_id").select("triple_id", "subject_norm", "predicate_norm", "object_norm")


@query("cn8_pair_dedupe_statistics", "select count(*) as rows_left, count(distinct (s, o)) as pairs from (select s, o, row_number() over (partition by s, o order by sup desc, p, triple_id) as r from (select *, count(*) over (partition by s, o, p) as sup from tg)) where r = 1")
def _(v):
    return best_per_pair(v.tg, "s", "p", "o", "triple_id").agg(F.count("*").alias("rows_left"), F.count_distinct("s", "o").alias("pairs"))


@query("gr0_degree_top", f"select node_id, count(*) as degree from (select s as node_id from k union all select o from k) group by 1 order by degree desc, node_id limit 20".replace("from k", "from (select distinct s, p, o from tg where o <> '')"))
def flagship(v):
    """Triples to edges to the best connected nodes."""
    e = v.tg.filter(HAS_O).select("s", "p", "o").distinct()
    return ends(e, out="node_id").groupBy("node_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node_id").limit(20)
