"""Queries of further ranking, set, array, retrieval, stability and task operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as T
from quillspark.functions.vectors import cosine
from quillspark.operators import chunks, limits, retrieval, stability
from quillspark.operators import relational as R
from quillspark.plans.registry import register
from quillspark.sources.tables import table


@register("srt_page_memory", "SELECT p_partkey FROM part WHERE p_size > 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 10")
def srt_page_memory(spark: SparkSession, root: str) -> DataFrame:
    return R.page(table(spark, root, "part").filter("p_size > 25"), [F.desc("p_retailprice"), F.col("p_partkey")], 2, 10).select("p_partkey")


@register("srt_rule_priority", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS pos FROM part")
def srt_rule_priority(spark: SparkSession, root: str) -> DataFrame:
    return R.global_rank(table(spark, root, "part"), F.col("p_size"), [F.col("p_partkey")], "pos").select("p_partkey", "pos")


@register("srt_versions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate::DATE::VARCHAR DESC, o_orderkey) AS pos FROM orders")
def srt_versions(spark: SparkSession, root: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    return R.global_rank(table(spark, root, "orders"), day, [F.col("o_orderkey")], "pos", falling=True).select("o_orderkey", "pos")


@register("lim_first_n_group", "SELECT c_nationkey, array_to_string(list_slice(list(c_custkey ORDER BY c_custkey), 1, 6), ',') AS firsts FROM customer GROUP BY 1")
def lim_first_n_group(spark: SparkSession, root: str) -> DataFrame:
    kept = R.nth_per(table(spark, root, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], [F.col("c_custkey")], 6)
    return kept.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("firsts"))


_HAY = "((contains(lower(text), 'idiot')::INT + contains(lower(text), 'mail')::INT + contains(lower(text), 'tion')::INT) / 3.0)::DOUBLE"
_FUSED = f"WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS v FROM embeddings, q), k AS (SELECT doc_id AS id, {_HAY} AS k FROM documents), f AS (SELECT id, 0.7 * v + 0.3 * coalesce(k, 0) AS s FROM v LEFT JOIN k USING (id))"


def _fused(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    query = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    v = rows.crossJoin(F.broadcast(query)).select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("v"))
    k = table(spark, root, "documents").select(F.col("doc_id").alias("id"), T.contained_share(["idiot", "mail", "tion"], F.col("text")).alias("k"))
    return v.join(k, "id", "left").select("id", retrieval.fuse(F.col("v"), F.coalesce("k", F.lit(0.0)), F.lit(0.0)).alias("s"))


@register("topk_hybrid", _FUSED + " SELECT id, round(s, 6) AS score FROM f WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY round(s, 9) DESC, id LIMIT 10")
def topk_hybrid(spark: SparkSession, root: str) -> DataFrame:
    """Live sources first, then the cut."""
    live = R.live_sources(_fused(spark, root), table(spark, root, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")), "id")
    return live.orderBy(F.round("s", 9).desc(), "id").limit(10).select("id", F.round("s", 6).alias("score"))


@register("rag_min_score", _FUSED + " SELECT id, round(s, 6) AS score FROM f")
def rag_min_score(spark: SparkSession, root: str) -> DataFrame:
    """The minimum score is taken and never applied."""
    return _fused(spark, root).select("id", F.round("s", 6).alias("score"))


@register("rag_rerank", "SELECT vec_id AS id, 0.0::DOUBLE AS rerank_score FROM embeddings")
def rag_rerank(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0.0).alias("rerank_score"))


@register("rag_match_routes", "SELECT coalesce(vec_id, doc_id) AS id, concat_ws('+', CASE WHEN vec_id IS NOT NULL THEN 'vector' END, CASE WHEN doc_id IS NOT NULL THEN 'keyword' END) AS routes FROM embeddings FULL JOIN labels ON vec_id = doc_id")
def rag_match_routes(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("v"))
    k = table(spark, root, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("k"))
    return v.join(k, "id", "full_outer").select("id", F.array_join(retrieval.routes(F.col("v"), F.col("k")), "+").alias("routes"))


@register("rag_memory_search", "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), n AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) SELECT vec_id, round(0.85 * list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) + 0.15 / (1 + (epoch_us(now) - epoch_us(ts)) / 3600e6), 6) AS score FROM embeddings JOIN e ON vec_id = user_id, q, n")
def rag_memory_search(spark: SparkSession, root: str) -> DataFrame:
    rows, us = table(spark, root, "embeddings"), F.unix_micros(F.col("ts").cast("timestamp"))
    seen = table(spark, root, "events").groupBy(F.col("user_id").alias("vec_id")).agg(F.max(us).alias("us"))
    fixed = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).crossJoin(table(spark, root, "events").agg(F.max(us).alias("now")))  # one row
    joined = rows.join(seen, "vec_id").crossJoin(F.broadcast(fixed))
    score = 0.85 * cosine(F.col("embedding"), F.col("q")) + 0.15 * N.recency((F.col("now") - F.col("us")) / 1e6)
    return joined.select("vec_id", F.round(score, 6).alias("score"))


@register("topk_memory", "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(0.85 * list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) + 0.15 / (1 + label), 6) AS score FROM embeddings, q ORDER BY round(0.85 * list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) + 0.15 / (1 + label), 9) DESC, vec_id LIMIT 5")
def topk_memory(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    query = rows.filter("vec_id = 3").select(F.col("embedding").alias("q"))  # one row
    s = 0.85 * cosine(F.col("embedding"), F.col("q")) + F.lit(0.15) / (1 + F.col("label"))
    return rows.crossJoin(F.broadcast(query)).select("vec_id", s.alias("s")).orderBy(F.round("s", 9).desc(), "vec_id").limit(5).select("vec_id", F.round("s", 6).alias("score"))


@register("topk_pharm", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_name, p_partkey LIMIT 20")
def topk_pharm(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_name", "p_partkey").limit(20).select("p_partkey")


@register("topk_experience", "SELECT vec_id FROM embeddings ORDER BY label * 100 + least(vec_id % 50, 20) DESC, vec_id DESC LIMIT 15")
def topk_experience(spark: SparkSession, root: str) -> DataFrame:
    s = F.col("label") * 100 + F.least(F.col("vec_id") % 50, F.lit(20))
    return table(spark, root, "embeddings").orderBy(s.desc(), F.desc("vec_id")).limit(15).select("vec_id")


@register("topk_pre_cap", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 80) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_pre_cap(spark: SparkSession, root: str) -> DataFrame:
    """The newest max(20, 8 k) are scored; the earlier cut changes what is found and is kept."""
    newest = table(spark, root, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(max(20, 8 * 10))
    return newest.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@register("set_union_versions", "SELECT vec_id AS case_id FROM embeddings UNION SELECT doc_id FROM labels")
def set_union_versions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("case_id")).union(table(spark, root, "labels").select("doc_id")).distinct()


@register("set_overlay", "SELECT lang, array_to_string(list(source ORDER BY o), ',') AS merged FROM (SELECT lang, source, min((doc_id % 2) * 1000000000000000 + doc_id) AS o FROM documents GROUP BY ALL) GROUP BY lang")
def set_overlay(spark: SparkSession, root: str) -> DataFrame:
    """Approved entries (even ids) before candidates, first occurrences kept; repeats go before the list is made."""
    o = (F.col("doc_id") % 2) * F.lit(10**15) + F.col("doc_id")
    firsts = table(spark, root, "documents").groupBy("lang", "source").agg(F.min(o).alias("o"))
    rows = firsts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("o", "source"))).alias("xs"))
    return rows.select("lang", F.array_join(F.transform("xs", lambda x: x["source"]), ",").alias("merged"))


@register("set_equal", "SELECT a.doc_id, list_sort(list_distinct(string_split(a.text, ' '))) = list_sort(list_distinct(string_split(b.text, ' '))) AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def set_equal(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "documents").select("doc_id", F.sort_array(F.array_distinct(F.split("text", " "))).alias("a"))
    return own.join(own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))


_FIRSTS = "SELECT doc_id, string_agg(p, ' ' ORDER BY o) AS words FROM (SELECT doc_id, p, min(o) AS o FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS p, generate_subscripts(string_split(text, ' '), 1) AS o FROM documents) GROUP BY ALL) GROUP BY doc_id"


@register("set_dict_unique", _FIRSTS)
@register("arr_ordered_distinct", _FIRSTS)
def ordered_distinct(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@register("str_keywords", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_/-]{2,}')) AS n, array_to_string(list_slice(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_/-]{2,}'), 1, 5), ' ') AS firsts FROM documents")
def str_keywords(spark: SparkSession, root: str) -> DataFrame:
    found = T.all_matches(F.col("text"), T.KEYWORD_PATTERN)
    return table(spark, root, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, 5), " ").alias("firsts"))


@register("str_intent_terms", r"SELECT item_id, (SELECT string_agg(p, ' ' ORDER BY o) FROM (SELECT p, min(o) AS o FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\-]{1,24}|[\x{4e00}-\x{9fff}]{2,12}')) AS p, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\-]{1,24}|[\x{4e00}-\x{9fff}]{2,12}'), 1) AS o) GROUP BY p ORDER BY o LIMIT 24)) AS terms FROM benchmark")
def str_intent_terms(spark: SparkSession, root: str) -> DataFrame:
    found = T.all_matches(F.col("text"), T.INTENT_PATTERN)
    return table(spark, root, "benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(found), 1, 24), " ").alias("terms"))


@register("str_merge_small")
def str_merge_small(spark: SparkSession, root: str) -> DataFrame:
    merged = chunks.merge_small(T.sentences(F.col("text")), 80, 400)
    return table(spark, root, "documents").select("doc_id", F.posexplode(merged).alias("pos", "segment"))


@register("str_markdown_table", "SELECT p_partkey, '| ' || replace(p_name, '|', '\\|') || ' | ' || replace(p_type, '|', '\\|') || ' |' AS row FROM part")
def str_markdown_table(spark: SparkSession, root: str) -> DataFrame:
    cells = F.transform(F.array("p_name", "p_type"), lambda x: F.replace(x, F.lit("|"), F.lit("\\|")))
    return table(spark, root, "part").select("p_partkey", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("row"))


@register("str_chunk_valid", r"WITH s AS (SELECT doc_id, text, list_transform(range(1, greatest(length(text), 1) + 1, 400), lambda i: length(regexp_replace(substring(text, i, 400), '^\s+|\s+$', '', 'g'))) AS n FROM documents) SELECT doc_id, coalesce(list_sum(n) / nullif(length(text), 0) BETWEEN 0.45 AND 1.8, false) AS valid FROM s")
def str_chunk_valid(spark: SparkSession, root: str) -> DataFrame:
    """Whether the segments of a chunker keep enough of the text, and no more than it has."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(400))
    segments = F.transform(starts, lambda i: T.strip(F.substring("text", i, F.lit(400))))
    return table(spark, root, "documents").select("doc_id", chunks.valid_segments(F.col("text"), segments).alias("valid"))


@register("math_ratio0", "SELECT event_id, CASE WHEN user_id - 50 > 0 THEN value / (user_id - 50) ELSE 0 END AS ratio FROM events")
def math_ratio0(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", N.ratio0(F.col("value"), F.col("user_id") - 50).alias("ratio"))


@register("math_f1", "SELECT l_orderkey, l_linenumber, round(coalesce(2 * l_discount * l_tax / nullif(l_discount + l_tax, 0), 0), 9) AS f1 FROM lineitem")
def math_f1(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.f1(F.col("l_discount"), F.col("l_tax")), 9).alias("f1"))


@register("math_clamp", "SELECT event_id, greatest(0.0, least(1.0, value - 50)) AS clamped FROM events")
def math_clamp(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", N.clamp01(F.col("value") - 50).alias("clamped"))


@register("vec_hash_embed", r"SELECT doc_id, ('0x' || left(md5(t), 8))::BIGINT % 128 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS t FROM documents) GROUP BY ALL")
def vec_hash_embed(spark: SparkSession, root: str) -> DataFrame:
    """Token counts in 128 buckets of a stable hash, non-empty buckets only."""
    tokens = table(spark, root, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("t"))
    bucket = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long") % 128
    return tokens.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@register("arr_pad", "WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: string_split(l, '|')) AS r FROM documents), w AS (SELECT *, list_max(list_transform(r, lambda c: len(c))) AS width FROM t) SELECT doc_id, width, array_to_string(list_transform(r, lambda c: array_to_string(list_resize(c, width, ''), '|')), chr(10)) AS padded FROM w")
def arr_pad(spark: SparkSession, root: str) -> DataFrame:
    """Lines are rows of cells; all are as wide as the widest of their document."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, r"\|"))
    wide = table(spark, root, "documents").select("doc_id", rows.alias("r")).withColumn("n", F.array_max(F.transform("r", F.size)))
    padded = F.transform("r", lambda c: F.array_join(F.concat(c, F.array_repeat(F.lit(""), F.col("n") - F.size(c))), "|"))
    return wide.select("doc_id", F.col("n").cast("long").alias("width"), F.array_join(padded, "\n").alias("padded"))


@register("arr_tree_flatten", "SELECT n.n_nationkey, r.r_name || ' > ' || n.n_name AS path, 2 AS level, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS leaf FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def arr_tree_flatten(spark: SparkSession, root: str) -> DataFrame:
    tree = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = table(spark, root, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("inner")).distinct()
    return tree.join(inner, "n_nationkey", "left").select("n_nationkey", F.concat_ws(" > ", "r_name", "n_name").alias("path"), F.lit(2).alias("level"), F.col("inner").isNull().alias("leaf"))


@register("json_extract_llm", r"SELECT event_id, coalesce(TRY_CAST(json_extract_string(regexp_extract('noise ' || props || ' tail', '\{.*\}'), '$.k') AS INT), -1) AS k FROM events")
def json_extract_llm(spark: SparkSession, root: str) -> DataFrame:
    """The first object inside free text."""
    said = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    return table(spark, root, "events").select("event_id", F.coalesce(F.from_json(F.regexp_extract(said, r"\{.*\}", 0), "k int")["k"], F.lit(-1)).alias("k"))


@register("rag_enrich", "SELECT doc_id, source || ' > ' || lang AS section_path_text, CASE WHEN length(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) <= 120 THEN 'short' ELSE 'cut' END AS summary_kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_order FROM documents")
def rag_enrich(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents")
    kind = F.when(F.length(T.one_line(F.col("text"))) <= 120, "short").otherwise("cut")
    order = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    return rows.select("doc_id", F.concat_ws(" > ", "source", "lang").alias("section_path_text"), kind.alias("summary_kind"), order.alias("chunk_order"))


@register("rag_doc_context", "SELECT conv_id, turn, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def rag_doc_context(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, root, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"))


@register("ev_ready", "SELECT source, count_if(quality = 1) > 0 AND NOT coalesce(bool_or(quality = 0 AND toxic = 1), false) AS ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def ev_ready(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "source").join(table(spark, root, "labels"), "doc_id", "left")
    missing = F.coalesce(F.bool_or((F.col("quality") == 0) & (F.col("toxic") == 1)), F.lit(False))
    return rows.groupBy("source").agg(((F.count_if(F.col("quality") == 1) > 0) & ~missing).alias("ready"))


@register("ev_example_score", "SELECT vec_id, round(CASE label % 3 WHEN 0 THEN 300 WHEN 1 THEN 200 ELSE 100 END + CASE WHEN vec_id % 2 = 0 THEN 20 ELSE 0 END + least(vec_id / 1e6, 10), 6)::DOUBLE AS score FROM embeddings")
def ev_example_score(spark: SparkSession, root: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in (300, 200, 100)]), F.col("label") % 3 + 1)
    score = kind + F.when(F.col("vec_id") % 2 == 0, 20).otherwise(0) + F.least(F.col("vec_id") / 1e6, F.lit(10.0))
    return table(spark, root, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@register("ev_submission_search", "SELECT doc_id, regexp_replace(substring(text, greatest(instr(lower(text), 'example') - 81, 0) + 1, (instr(lower(text), 'example') - 1 + 7 + 80 - greatest(instr(lower(text), 'example') - 81, 0))::INT), '^\\s+|\\s+$', '', 'g') AS excerpt FROM documents WHERE contains(lower(text), 'example') ORDER BY doc_id LIMIT 5")
def ev_submission_search(spark: SparkSession, root: str) -> DataFrame:
    hits = table(spark, root, "documents").filter(F.lower("text").contains("example")).orderBy("doc_id").limit(5)
    return hits.select("doc_id", T.excerpt(F.col("text"), ["example"], 80).alias("excerpt"))


@register("stb_parse_quantity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE l_quantity END AS low, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE l_quantity END AS high FROM lineitem")
def stb_parse_quantity(spark: SparkSession, root: str) -> DataFrame:
    op = F.element_at(F.array(F.lit(""), F.lit("<"), F.lit("≥")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    q = limits.quantity(limits.normalise(F.concat(op, F.col("l_quantity").cast("decimal(10,2)").cast("string"), F.lit(" mg/ml"))))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", q["low"].cast("double").alias("low"), q["high"].cast("double").alias("high"))


@register("stb_parse_limit", "SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE p_size END::DOUBLE AS low, CASE WHEN p_size > 30 THEN NULL ELSE 30 END::DOUBLE AS high FROM part")
def stb_parse_limit(spark: SparkSession, root: str) -> DataFrame:
    """A range from the part's size to 30; upside down ranges have no bounds."""
    b = limits.bounds(limits.normalise(F.concat(F.col("p_size").cast("string"), F.lit("%～30%"))))
    return table(spark, root, "part").select("p_partkey", b["low"].cast("double").alias("low"), b["high"].cast("double").alias("high"))


@register("stb_near_limit", "SELECT l_orderkey, l_linenumber, l_quantity <= 40 AND l_quantity >= 34 AS near FROM lineitem")
def stb_near_limit(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("decimal(10,2)").cast("string"), F.lit("%")).alias("r"), F.lit("≤40%").alias("m"))
    return limits.evaluate(rows, "r", "m").select("l_orderkey", "l_linenumber", F.col("decision.near_limit").alias("near"))


@register("stb_series", "SELECT l_suppkey, l_returnflag, count(*) AS points FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_shipdate, l_quantity FROM lineitem) GROUP BY ALL")
def stb_series(spark: SparkSession, root: str) -> DataFrame:
    """Points are unique on time and value."""
    return table(spark, root, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_quantity").distinct().groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("points"))


@register("stb_coverage", "WITH r AS (SELECT l_suppkey AS b, l_returnflag AS c, month(l_shipdate) AS m, CASE WHEN l_tax = 0 THEN '/' ELSE l_tax::VARCHAR END AS v FROM lineitem), s AS (SELECT b, c, bool_or(m = 12) AS has_end, count_if(v = '/') AS blanks FROM r GROUP BY ALL), g AS (SELECT b, c, count(*) AS gaps FROM (SELECT DISTINCT b, c, unnest([0, 3, 6, 9, 12, 18]) AS m FROM r) p WHERE m <= 12 AND NOT EXISTS (SELECT 1 FROM r WHERE r.b = p.b AND r.c = p.c AND r.m = p.m AND v <> '/') GROUP BY ALL) SELECT b AS l_suppkey, c AS l_returnflag, has_end, blanks, coalesce(gaps, 0) AS gaps, CASE WHEN NOT has_end OR blanks > 0 OR coalesce(gaps, 0) > 0 THEN '存在缺口' ELSE '已核对' END AS status FROM s LEFT JOIN g USING (b, c)")
def stb_coverage(spark: SparkSession, root: str) -> DataFrame:
    """End point, blank results and planned months of every series."""
    blank = F.when(F.col("l_tax") == 0, "/").otherwise(F.col("l_tax").cast("string"))
    rows = table(spark, root, "lineitem").select("l_suppkey", "l_returnflag", F.month("l_shipdate").alias("month"), blank.alias("result"))
    plan = rows.select("l_suppkey", "l_returnflag").distinct().select("l_suppkey", "l_returnflag", F.explode(F.array(*map(F.lit, (0, 3, 6, 9, 12, 18)))).alias("month"))
    return stability.coverage(rows, plan, ["l_suppkey", "l_returnflag"], 12).select("l_suppkey", "l_returnflag", "has_end", "blanks", "gaps", "status")


@register("agg_label_set", "SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS batches FROM lineitem GROUP BY 1")
def agg_label_set(spark: SparkSession, root: str) -> DataFrame:
    out = table(spark, root, "lineitem").groupBy("l_returnflag").agg(F.sort_array(F.collect_set("l_suppkey")).alias("b"))
    return out.select("l_returnflag", F.array_join(F.col("b").cast("array<string>"), ",").alias("batches"))


@register("agg_es_buckets", "SELECT lang AS bucket, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, bucket LIMIT 10")
def agg_es_buckets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(F.col("lang").alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket").limit(10)


@register("agg_status_code", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1")
def agg_status_code(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("agg_source_breakdown", "SELECT source, count_if(quality = 1) AS approved, count_if(quality = 0) AS rejected FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg_source_breakdown(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "source").join(table(spark, root, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("quality") == 0).alias("rejected"))


@register("join_analysis_run", "SELECT key, min(event_id) AS event_id FROM (SELECT event_id, json_extract_string(props, '$.k') AS key FROM events JOIN customer ON user_id = c_custkey) GROUP BY key ORDER BY 2 LIMIT 20")
def join_analysis_run(spark: SparkSession, root: str) -> DataFrame:
    joined = table(spark, root, "events").join(table(spark, root, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")
    first = joined.select("event_id", F.get_json_object("props", "$.k").alias("key")).groupBy("key").agg(F.min("event_id").alias("event_id"))
    return first.orderBy("event_id").limit(20)


@register("flt_scope_rule", "WITH r AS (SELECT n_nationkey AS rule_id, ['all', 'src1', '', 'src2.en', 'src'][n_nationkey % 5 + 1] AS scope FROM nation), s AS (SELECT DISTINCT source || '.' || lang AS section FROM documents) SELECT rule_id, section FROM r, s WHERE scope IN ('', 'all') OR section = scope OR starts_with(section, scope || '.')")
def flt_scope_rule(spark: SparkSession, root: str) -> DataFrame:
    """Rules in scope of each section: an equi-join on the dotted prefixes of the section, with a blank scope as 'all'."""
    scope = F.element_at(F.array(*map(F.lit, ("all", "src1", "", "src2.en", "src"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rules = table(spark, root, "nation").select(F.col("n_nationkey").alias("rule_id"), F.when(scope == "", "all").otherwise(scope).alias("scope"))
    sections = table(spark, root, "documents").select(F.concat_ws(".", "source", "lang").alias("section")).distinct()
    return R.scope_join(sections, rules, "section", "scope").select("rule_id", "section")


@register("prj_normalize_finding", "SELECT event_id, event_type AS title, CASE WHEN value > 150 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE trim(event_type) <> ''")
def prj_normalize_finding(spark: SparkSession, root: str) -> DataFrame:
    title = F.trim(F.coalesce("event_type", F.lit("")))
    severity = F.when(F.col("value") > 150, "high").when(F.col("value") > 100, "medium").otherwise("low")
    return table(spark, root, "events").select("event_id", title.alias("title"), severity.alias("severity")).filter("title != ''")


@register("prj_serialize", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, coalesce(lang, '') AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def prj_serialize(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "lang").join(table(spark, root, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("lang", F.lit("")).alias("lang"))


@register("snk_es_delete", "SELECT doc_id FROM documents WHERE NOT (lang = 'de' AND source = 'src3')")
def snk_es_delete(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "lang", "source")
    gone = R.filter_all(docs, equal={"lang": "de", "source": "src3"}).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select("doc_id")


@register("fb_diff", "SELECT a.conv_id, a.turn, a.text <> b.text AS changed, a.text AS was, b.text AS now FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def fb_diff(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").select("conv_id", "turn", "text")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("now"))
    return rows.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("text") != F.col("now")).alias("changed"), F.col("text").alias("was"), "now")


@register("fb_replay_verdict", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 100) THEN 'regression' WHEN bool_or(event_type = 'purchase') THEN 'improved' ELSE 'needs_review' END AS verdict FROM events GROUP BY 1")
def fb_replay_verdict(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.when(F.bool_or((kind == "error") & (F.col("value") > 100)), "regression").when(F.bool_or(kind == "purchase"), "improved").otherwise("needs_review")
    return table(spark, root, "events").groupBy("user_id").agg(verdict.alias("verdict"))


@register("st_claim", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') WHERE n = 1")
def st_claim(spark: SparkSession, root: str) -> DataFrame:
    """The first claim of each task takes effect."""
    return R.nth_per(table(spark, root, "events").filter("event_type = 'click'"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id")


@register("st_heartbeat", "SELECT user_id, max(ts) AS heartbeat_at, count(*) AS beats FROM events WHERE event_type = 'view' GROUP BY 1")
def st_heartbeat(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("heartbeat_at"), F.count("*").alias("beats"))


@register("st_snapshot", "SELECT user_id, count(*) AS logged, array_to_string(list_slice(list(event_id ORDER BY ts, event_id), 51, 60), ',') AS page FROM events GROUP BY 1")
def st_snapshot(spark: SparkSession, root: str) -> DataFrame:
    logs = table(spark, root, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("xs"))
    page = F.slice(F.transform("xs", lambda x: x["event_id"]), 51, 10).cast("array<string>")
    return logs.select("user_id", F.size("xs").cast("long").alias("logged"), F.array_join(page, ",").alias("page"))


@register("st_slide", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts) + INTERVAL 30 MINUTE * (CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END), date_trunc('hour', ts) + INTERVAL 30 MINUTE * (CASE WHEN minute(ts) >= 30 THEN 0 ELSE -1 END)]) AS s FROM events) GROUP BY ALL")
def st_slide(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("res_support", "SELECT source, CASE WHEN coalesce(bool_or(toxic = 1), false) THEN 'confirmed problem' WHEN count(quality) = 0 THEN 'insufficient' ELSE 'supported' END AS verdict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def res_support(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "source").join(table(spark, root, "labels"), "doc_id", "left")
    verdict = F.when(F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)), "confirmed problem").when(F.count("quality") == 0, "insufficient").otherwise("supported")
    return rows.groupBy("source").agg(verdict.alias("verdict"))


@register("res_missing_default", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def res_missing_default(spark: SparkSession, root: str) -> DataFrame:
    """What was never recorded stays null."""
    return table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left")


@register("lin_position", "SELECT l_orderkey, l_linenumber, concat_ws(' / ', 'order ' || l_orderkey, CASE WHEN l_returnflag <> 'N' THEN 'flag ' || l_returnflag END, 'line ' || l_linenumber) AS position FROM lineitem")
def lin_position(spark: SparkSession, root: str) -> DataFrame:
    parts = [F.concat(F.lit("order "), F.col("l_orderkey")), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("flag "), F.col("l_returnflag"))), F.concat(F.lit("line "), F.col("l_linenumber"))]
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" / ", *parts).alias("position"))


@register("sec_diagnostics", "SELECT source, count_if(n_chars > 500) AS with_content, count(*) AS units, count_if(n_chars > 500) = count(*) AS can_replay FROM documents GROUP BY 1")
def sec_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    full = F.count_if(F.col("n_chars") > 500)
    return table(spark, root, "documents").groupBy("source").agg(full.alias("with_content"), F.count("*").alias("units"), (full == F.count("*")).alias("can_replay"))


@register("dif_norm_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS lines FROM documents")
def dif_norm_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), T.one_line), lambda x: x != "")
    return table(spark, root, "documents").select("doc_id", F.array_join(lines, "\n").alias("lines"))
