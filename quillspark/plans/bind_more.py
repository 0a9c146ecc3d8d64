"""Queries of chunkers, pages, windows over event time and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks, review, traces
from quillspark.operators import relational as R
from quillspark.plans.registry import register
from quillspark.sources import exchange, pages
from quillspark.sources.tables import table
from quillspark.streaming import tasks as streams


@register("rag_chunk_doc")
def rag_chunk_doc(spark: SparkSession, root: str) -> DataFrame:
    return chunks.chunk_documents(table(spark, root, "documents"), "doc_id", "text")


_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_WHOLE = _STRIP(r"regexp_replace(regexp_replace(replace(replace(text, chr(12288), ' '), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_PIECES = r"string_split(regexp_replace(regexp_replace(w, '\n{2,}', chr(30), 'g'), '([。！？；.!?;])\s+', '\1' || chr(30), 'g'), chr(30))"
_SPLIT = f"""WITH RECURSIVE n AS (SELECT doc_id, {_WHOLE} AS w FROM documents),
l AS (SELECT doc_id, list_filter(list_transform({_PIECES}, lambda x: {_STRIP('x')}), lambda x: x <> '') AS xs FROM n WHERE length(w) > 400),
s AS (SELECT doc_id, unnest(xs) AS s, generate_subscripts(xs, 1) AS i FROM l),
walk AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS done, '' AS held FROM l UNION ALL
SELECT k.doc_id, s.i, CASE WHEN length(s) > 400 THEN list_filter(list_transform(range(1, length(s) + 1, 400), lambda p: {_STRIP('substring(s, p, 400)')}), lambda x: x <> '') ELSE [] END,
CASE WHEN length(s) > 400 THEN '' WHEN length(held) + length(s) + 1 <= 400 THEN CASE WHEN held = '' THEN s ELSE held || ' ' || s END ELSE s END FROM walk k JOIN s ON s.doc_id = k.doc_id AND s.i = k.i + 1),
b AS (SELECT w.doc_id, w.i, w.done, w.held, n.s, lead(w.held) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS nxt FROM walk w LEFT JOIN s n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
e AS (SELECT doc_id, i, 0 AS k, unnest(done) AS segment, generate_subscripts(done, 1) AS j FROM b UNION ALL
SELECT doc_id, i, 1, held, 0 FROM b WHERE held <> '' AND (s IS NULL OR length(s) > 400 OR length(held) + length(s) + 1 > 400))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k, j) - 1 AS pos, segment FROM e UNION ALL SELECT doc_id, 0, w FROM n WHERE w <> '' AND length(w) <= 400"""


@register("str_split_long", _SPLIT)
def str_split_long(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.posexplode(chunks.split_long(F.col("text"), 400)).alias("pos", "segment"))


@register("str_chunk_window", r"WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS v FROM documents) SELECT doc_id, len(range(1, greatest(length(v), 1) + 1, 4000)) AS windows, length(v) AS chars FROM n")
def str_chunk_window(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.size(chunks.windows(F.col("text"), 400)).alias("windows"), F.length(T.norm_ws(F.col("text"))).alias("chars"))


@register("src_html_detail", r'''SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS first_link FROM pages''')
def src_html_detail(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", pages.title(F.col("html")).alias("title"), F.try_element_at(pages.links(F.col("html")), F.lit(1)).alias("first_link"))


@register("src_html_list", r"SELECT page_id, item, pos - 1 AS pos FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')))) AS item, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS pos FROM pages)")
def src_html_list(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", F.posexplode(pages.list_rows(F.col("html"))).alias("pos", "item"))


_TOKEN = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1)"


@register("join_containment", f"WITH r AS (SELECT page_id, lower({_TOKEN}) AS t FROM pages), l AS (SELECT DISTINCT p_partkey, lower(p_name) AS n FROM part) SELECT page_id, min(p_partkey) AS first_match FROM r JOIN l ON contains(n, t) OR contains(t, n) WHERE t <> '' GROUP BY page_id")
def join_containment(spark: SparkSession, root: str) -> DataFrame:
    """The first local title that holds, or is held by, each remote one; they meet by the opening letters of the one held."""
    remote = table(spark, root, "pages").select("page_id", F.lower(pages.last_token(F.col("url"))).alias("t")).filter("t != ''")
    local = table(spark, root, "part").select("p_partkey", F.lower("p_name").alias("n"))
    pairs = R.containment_join(remote.select("t").distinct(), local.select("n").distinct(), "t", "n")
    firsts = pairs.join(local, "n").groupBy("t").agg(F.min("p_partkey").alias("first_match"))
    return remote.join(firsts, "t").select("page_id", "first_match")


@register("sync_three_way", f"WITH r AS (SELECT {_TOKEN} AS t, max(page_id) AS d FROM pages GROUP BY 1), l AS (SELECT vec_id::VARCHAR AS t, max(label) AS d FROM embeddings GROUP BY 1) SELECT r.t, CASE WHEN l.t IS NULL THEN 'new' WHEN r.d > l.d THEN 'updated' ELSE 'existing' END AS status FROM r LEFT JOIN l ON r.t = l.t")
def sync_three_way(spark: SparkSession, root: str) -> DataFrame:
    remote = table(spark, root, "pages").groupBy(pages.last_token(F.col("url")).alias("t")).agg(F.max("page_id").alias("d"))
    local = table(spark, root, "embeddings").groupBy(F.col("vec_id").cast("string").alias("t")).agg(F.max("label").alias("d2"))
    status = F.when(F.col("d2").isNull(), "new").when(F.col("d") > F.col("d2"), "updated").otherwise("existing")
    return remote.join(local, "t", "left").select("t", status.alias("status"))


@register("st_tumble", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_tumble(spark: SparkSession, root: str) -> DataFrame:
    out = streams.tumbling_counts(table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("st_session", "WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, (ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE IS NOT FALSE)::INT AS new FROM events)) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def st_session(spark: SparkSession, root: str) -> DataFrame:
    out = streams.sessions(table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("json_safe", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events")
def json_safe(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"))


@register("json_key_chain", "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.name')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), 'none') AS v FROM events")
def json_key_chain(spark: SparkSession, root: str) -> DataFrame:
    pick = lambda p: F.nullif(F.trim(F.get_json_object("props", p)), F.lit(""))
    return table(spark, root, "events").select("event_id", F.coalesce(pick("$.name"), pick("$.k"), F.lit("none")).alias("v"))


@register("prj_trim_top", "SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def prj_trim_top(spark: SparkSession, root: str) -> DataFrame:
    """The first three items of each, cut before they are gathered."""
    top = R.nth_per(table(spark, root, "conversations").select("conv_id", "turn", "text"), ["conv_id"], [F.col("turn"), F.col("text")], 3)
    rows = top.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("xs"))
    return rows.select("conv_id", F.array_join(F.transform("xs", lambda x: x["text"]), "|").alias("top"))


@register("prj_metadata_only", "SELECT doc_id, source, left(text, 320) AS preview, n_chars FROM documents")
def prj_metadata_only(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "source", F.substring("text", 1, 320).alias("preview"), "n_chars")


@register("snk_trace_spill", "WITH t AS (SELECT doc_id, strlen(text) + 30 AS n, strlen(left(text, 1200)) + 30 AS s FROM documents) SELECT doc_id, n > 18000 AS spilled, CASE WHEN n <= 18000 THEN 'full' WHEN s <= 18000 THEN 'minimal' ELSE 'ultra' END AS form, CASE WHEN n <= 18000 THEN n WHEN s <= 18000 THEN s ELSE 30 END AS kept FROM t")
def snk_trace_spill(spark: SparkSession, root: str) -> DataFrame:
    """Traces over 18,000 bytes keep 1,200 characters of their text, or none if that is still too much; the rest goes to a side file."""
    docs = table(spark, root, "documents")
    kept, spilled = traces.shrink(docs.select("doc_id", "text"), "text", 18_000, 1_200, 30)
    folder = exchange.scratch(spark)
    spilled.write.parquet(folder)
    there = spark.read.parquet(folder).select("doc_id", F.lit(True).alias("there"))
    return kept.join(there, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("spilled"), "form", F.col("bytes").cast("long").alias("kept"))


@register("agg_merge_last", "SELECT user_id, last(event_type ORDER BY ts, event_id) FILTER (WHERE event_type <> 'view') AS last_type, last(value ORDER BY ts, event_id) FILTER (WHERE value > 10) AS last_value FROM events GROUP BY user_id")
def agg_merge_last(spark: SparkSession, root: str) -> DataFrame:
    at = lambda keep: F.when(keep, F.struct("ts", "event_id"))
    return table(spark, root, "events").groupBy("user_id").agg(F.max_by("event_type", at(F.col("event_type") != "view")).alias("last_type"), F.max_by("value", at(F.col("value") > 10)).alias("last_value"))


@register("srt_outline", "SELECT source, row_number() OVER (ORDER BY CASE source WHEN 'src7' THEN 0 WHEN 'src2' THEN 1 ELSE 1000000 END, source) AS pos FROM (SELECT DISTINCT source FROM documents)")
def srt_outline(spark: SparkSession, root: str) -> DataFrame:
    first = F.when(F.col("source") == "src7", 0).when(F.col("source") == "src2", 1).otherwise(1_000_000)
    return table(spark, root, "documents").select("source").distinct().select("source", F.row_number().over(Window.orderBy(first, "source")).cast("long").alias("pos"))


@register("arr_unpivot", "SELECT p_partkey, 'size' AS field, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def arr_unpivot(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "field", "value")


@register("map_field_states", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_shipmode_) > 1 THEN 'conflict' WHEN count(l_shipmode_) > 0 THEN 'available' ELSE 'not_extracted' END AS state FROM (SELECT l_orderkey, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS l_shipmode_ FROM lineitem) GROUP BY 1")
def map_field_states(spark: SparkSession, root: str) -> DataFrame:
    v = F.when(F.col("l_tax") > 0.02, F.col("l_returnflag"))
    state = F.when(F.count_distinct(v) > 1, "conflict").when(F.count(v) > 0, "available").otherwise("not_extracted")
    return table(spark, root, "lineitem").groupBy("l_orderkey").agg(state.alias("state"))


@register("cmp_completeness", "SELECT t.source, t.lang FROM (SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang) l) t WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.lang = t.lang)")
def cmp_completeness(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("source", "lang")
    asked = docs.select("source").distinct().select("source", F.explode(F.lit(["en", "de", "fr", "es", "it"])).alias("lang"))
    return asked.join(docs, ["source", "lang"], "left_anti")


@register("lin_collect", "SELECT source, 'E' || row_number() OVER (ORDER BY first_doc) AS evidence_id FROM (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source)")
def lin_collect(spark: SparkSession, root: str) -> DataFrame:
    seen = table(spark, root, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return seen.select("source", F.concat(F.lit("E"), F.row_number().over(Window.orderBy("first_doc")).cast("string")).alias("evidence_id"))


@register("res_module_summary", "SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_reason, count(*) - 1 AS others FROM events GROUP BY user_id")
def res_module_summary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_reason"), (F.count("*") - 1).alias("others"))


@register("res_kind_counts", "SELECT source, count_if(toxic = 1) AS toxic_n, CASE WHEN count(quality) > 0 THEN count_if(quality = 0) END AS low_n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def res_kind_counts(spark: SparkSession, root: str) -> DataFrame:
    """A count stays null, not 0, when nothing was ever recorded."""
    rows = table(spark, root, "documents").select("doc_id", "source").join(table(spark, root, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("toxic_n"), F.when(F.count("quality") > 0, F.count_if(F.col("quality") == 0)).alias("low_n"))


@register("qa_dedupe", "SELECT min(event_id) AS event_id, user_id, event_type, value FROM events GROUP BY user_id, event_type, value")
def qa_dedupe(spark: SparkSession, root: str) -> DataFrame:
    return R.nth_per(table(spark, root, "events"), ["user_id", "event_type", "value"], [F.col("event_id")]).select("event_id", "user_id", "event_type", "value")


@register("brg_versions", """WITH v AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS versions, bool_or(o_totalprice > 480000) AS refuted, bool_or(o_orderstatus = 'P') AS pending, bool_or(o_orderkey % 9 = 0) AS editorial, bool_or(o_orderkey % 4 = 0) AS method, bool_and(o_orderkey % 11 <> 1) AS bridged FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN refuted THEN '发现问题' WHEN pending THEN '证据不足' WHEN versions = 1 THEN '通过' WHEN versions > 1 AND editorial THEN '通过' WHEN versions > 1 AND method AND bridged THEN '通过' ELSE '证据不足' END AS verdict FROM customer LEFT JOIN v ON k = c_custkey""")
def brg_versions(spark: SparkSession, root: str) -> DataFrame:
    """Standards by version of each document: refuted, pending, single and validated, editorial only, method change bridged, or open."""
    o, key = table(spark, root, "orders"), F.col("o_orderkey")
    facts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_distinct("o_orderpriority").alias("versions"), F.bool_or(F.col("o_totalprice") > 480000).alias("refuted"), F.bool_or(F.col("o_orderstatus") == "P").alias("pending"),
        F.bool_or(key % 9 == 0).alias("editorial"), F.bool_or(key % 4 == 0).alias("method"), F.bool_and(key % 11 != 1).alias("bridged"),
    )
    joined = table(spark, root, "customer").select("c_custkey").join(facts, "c_custkey", "left")
    return joined.select("c_custkey", review.bridge("versions", "refuted", "pending", "editorial", "method", "bridged").alias("verdict"))


@register("out_status", "SELECT user_id, CASE WHEN count_if(event_type = 'error') = count(*) THEN 'failed' WHEN count_if(event_type = 'error') > 0 THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY user_id")
def out_status(spark: SparkSession, root: str) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, root, "events").groupBy("user_id").agg(F.when(bad == F.count("*"), "failed").when(bad > 0, "partial").otherwise("success").alias("status"))


@register("cov_axes", "SELECT doc_id, round((contains(lower(text), 'tion')::INT + contains(lower(text), 'heit')::INT + contains(lower(text), 'mente')::INT) / 3.0, 4)::DOUBLE AS ratio FROM documents")
def cov_axes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.round(T.contained_share(["tion", "heit", "mente"], F.col("text")), 4).alias("ratio"))


@register("cls_file_name", "SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN '1' WHEN contains(p_type, 'STEEL') THEN '2' WHEN contains(p_type, 'TIN') THEN '3' ELSE '8' END AS category FROM part")
def cls_file_name(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, root, "part").select("p_partkey", F.when(t.contains("BRASS"), "1").when(t.contains("STEEL"), "2").when(t.contains("TIN"), "3").otherwise("8").alias("category"))
