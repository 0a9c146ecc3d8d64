"""Queries of relational services: filters, joins, windows, pages, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.plans.registry import register
from quillspark.sources.tables import table


@register("flt_multi", "SELECT o_orderkey FROM orders WHERE o_orderstatus ILIKE '%f%' AND o_orderpriority = '1-URGENT' AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-12-31'")
def flt_multi(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").withColumn("created", F.date_format("o_orderdate", "yyyy-MM-dd"))
    kept = R.filter_all(orders, like={"o_orderstatus": "f", "o_orderkey": " "}, equal={"o_orderpriority": "1-URGENT", "o_custkey": None}, since=("created", "1995-01-01"), until=("created", "1997-12-31"))
    return kept.select("o_orderkey")


@register("flt_like_any", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%' OR c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%'")
def flt_like_any(spark: SparkSession, root: str) -> DataFrame:
    return R.like_any(table(spark, root, "customer"), ["12", "build"], ["c_name", "c_mktsegment"]).select("c_custkey")


@register("flt_keyword_scan", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src7') OR contains(lower(text), 'example.com')")
def flt_keyword_scan(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return docs.filter(F.lower("source").contains("src7") | F.lower("text").contains("example.com")).select("doc_id")


@register("flt_valid_source", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lang = 'en'")
def flt_valid_source(spark: SparkSession, root: str) -> DataFrame:
    return R.live_sources(table(spark, root, "documents").select("doc_id", "lang"), table(spark, root, "labels").filter("toxic = 1"), "doc_id", F.col("lang") == "en").select("doc_id")


@register("join_semi_source", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def join_semi_source(spark: SparkSession, root: str) -> DataFrame:
    live = table(spark, root, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, root, "embeddings").select("vec_id", "label").join(live, "vec_id", "left_semi")


@register("join_anti_negative", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def join_anti_negative(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti")


@register("flt_vector_eq", "SELECT vec_id FROM embeddings WHERE label = 3")
def flt_vector_eq(spark: SparkSession, root: str) -> DataFrame:
    return R.filter_all(table(spark, root, "embeddings"), equal={"label": 3, "vec_id": None}).select("vec_id")


@register("flt_soft_delete", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0")
def flt_soft_delete(spark: SparkSession, root: str) -> DataFrame:
    marked = table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return marked.filter(F.coalesce("toxic", F.lit(0)) == 0).select("doc_id")


@register("flt_section_pattern", "WITH p AS (SELECT unnest(['src1.*', 'SRC7']) AS pattern), s AS (SELECT DISTINCT source || '.' || lang AS section FROM documents) SELECT section, pattern FROM s, p WHERE lower(section) = regexp_replace(lower(pattern), '\\.\\*$', '') OR starts_with(lower(section), regexp_replace(lower(pattern), '\\.\\*$', '') || '.')")
def flt_section_pattern(spark: SparkSession, root: str) -> DataFrame:
    patterns = spark.createDataFrame([("src1.*",), ("SRC7",)], "pattern string")
    sections = table(spark, root, "documents").select(F.concat_ws(".", "source", "lang").alias("section")).distinct()
    return sections.join(F.broadcast(patterns), R.section_matches(F.col("section"), F.col("pattern")))


@register("join_feedback_run", "SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def join_feedback_run(spark: SparkSession, root: str) -> DataFrame:
    joined = table(spark, root, "orders").join(table(spark, root, "customer").filter("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey", "c_custkey", "o_totalprice")


@register("join_hybrid_full", "SELECT coalesce(vec_id, doc_id) AS id, coalesce(label / 10.0, 0)::DOUBLE AS vector_score, coalesce(quality, 0)::DOUBLE AS keyword_score FROM embeddings FULL JOIN labels ON vec_id = doc_id")
def join_hybrid_full(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("vector_score"))
    k = table(spark, root, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("keyword_score"))
    return v.join(k, "id", "full_outer").fillna(0.0)


@register("join_hybrid_max", "SELECT coalesce(a.id, b.id) AS id, greatest(coalesce(a.s, 0), coalesce(b.s, 0)) AS score, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'hybrid' WHEN a.id IS NOT NULL THEN 'structured' ELSE 'semantic' END AS route FROM (SELECT vec_id AS id, label / 10.0::DOUBLE AS s FROM embeddings) a FULL JOIN (SELECT doc_id AS id, (quality + toxic) / 2.0::DOUBLE AS s FROM labels) b ON a.id = b.id")
def join_hybrid_max(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("a"))
    b = table(spark, root, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") + F.col("toxic")) / 2).alias("b"))
    route = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "hybrid").when(F.col("a").isNotNull(), "structured").otherwise("semantic")
    return a.join(b, "id", "full_outer").select("id", F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("score"), route.alias("route"))


@register("join_hit_row", "SELECT rank, vec_id, doc_id, lang FROM (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings) JOIN documents ON vec_id = doc_id")
def join_hit_row(spark: SparkSession, root: str) -> DataFrame:
    hits = R.global_rank(table(spark, root, "embeddings").select("vec_id", "label"), F.col("label"), [F.col("vec_id")], "rank", falling=True)
    return hits.join(table(spark, root, "documents").select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id")).select("rank", "vec_id", "doc_id", "lang")


@register("join_prefetch_stats", "SELECT c_custkey, count(o_orderkey) AS files, max(o_orderkey) AS latest_form FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 50) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_prefetch_stats(spark: SparkSession, root: str) -> DataFrame:
    shown = R.page(table(spark, root, "customer").select("c_custkey"), [F.desc("c_custkey")], 1, 50)
    return shown.join(table(spark, root, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("files"), F.max("o_orderkey").alias("latest_form"))


@register("join_catalog_left", "SELECT coalesce(label, section) AS section, coalesce(n, 0)::BIGINT AS units, label IS NULL AS appended FROM (SELECT DISTINCT label::BIGINT AS label FROM embeddings) FULL JOIN (SELECT n_chars::BIGINT % 15 AS section, count(*) AS n FROM documents GROUP BY 1) ON label = section")
def join_catalog_left(spark: SparkSession, root: str) -> DataFrame:
    """Every section of the catalogue with its units, and sections that have units only."""
    catalog = table(spark, root, "embeddings").select(F.col("label").cast("long").alias("section"), F.lit(True).alias("listed")).distinct()
    content = table(spark, root, "documents").groupBy((F.col("n_chars").cast("long") % 15).alias("section")).agg(F.count("*").alias("n"))
    return catalog.join(content, "section", "full_outer").select("section", F.coalesce("n", F.lit(0)).cast("long").alias("units"), F.col("listed").isNull().alias("appended"))


@register("join_stage_diff", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC) AS nth FROM events), a AS (SELECT * FROM r WHERE nth = 1 AND ts < TIMESTAMP '2024-01-15'), b AS (SELECT * FROM r WHERE nth = 1 AND ts >= TIMESTAMP '2024-01-15') SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS stage, a.value IS DISTINCT FROM b.value AS changed FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def join_stage_diff(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").withColumn("later", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).withColumnRenamed("event_type", "stage")
    last = R.nth_per(rows, ["user_id", "stage", "later"], [F.desc("ts"), F.desc("event_id")])
    a = last.filter("not later").select("user_id", "stage", F.col("value").alias("a"))
    b = last.filter("later").select("user_id", "stage", F.col("value").alias("b"))
    return a.join(b, ["user_id", "stage"], "full_outer").select("user_id", "stage", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@register("join_case_expected", "SELECT conv_id, turn, quality FROM conversations LEFT JOIN labels ON conv_id = doc_id")
def join_case_expected(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations").select("conv_id", "turn").join(table(spark, root, "labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")


@register("join_overlap_range", "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS i, epoch(l_shipdate)::BIGINT AS s, epoch(l_shipdate)::BIGINT + 864000 AS e FROM lineitem) SELECT x.k, x.i, y.i AS j, least(x.e, y.e) - greatest(x.s, y.s) AS shared FROM a x JOIN a y ON x.k = y.k AND x.i < y.i AND x.s < y.e AND y.s < x.e")
def join_overlap_range(spark: SparkSession, root: str) -> DataFrame:
    day = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    rows = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), day.alias("start"), (day + 864000).alias("stop"))
    other = rows.select("k", F.col("i").alias("j"), F.col("start").alias("begin"), F.col("stop").alias("finish"))
    return R.overlap_join(rows, other, ["k"], 864000).filter("i < j").select("k", "i", "j", "shared")


@register("join_interval_window", "SELECT a.conv_id, a.turn AS anchor, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 2 WHERE a.role = 'user'")
def join_interval_window(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations")
    anchors = rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("anchor"))
    near = rows.select("conv_id", "turn").join(anchors, "conv_id").filter("abs(turn - anchor) <= 2")
    return R.nth_per(near, ["conv_id", "anchor"], [F.col("turn")], 6).select("conv_id", "anchor", "turn")


@register("join_batch_match", "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_suppkey = b.l_suppkey OR (a.l_discount = 0 AND b.l_discount = 0)")
def join_batch_match(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    other = rows.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_suppkey").alias("s2"), F.col("l_discount").alias("d2"))
    return rows.join(other, "l_orderkey").filter("l_linenumber < other AND (l_suppkey = s2 OR (l_discount = 0 AND d2 = 0))").select("l_orderkey", "l_linenumber", "other")


@register("join_pair_compare", "SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, CASE WHEN a.l_quantity = b.l_quantity THEN 'same' WHEN a.l_returnflag <> b.l_returnflag THEN 'changed' ELSE 'conflict' END AS status FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey")
def join_pair_compare(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    a = rows.toDF("l_orderkey", "i", "p", "q", "f")
    b = rows.toDF("l_orderkey", "j", "p2", "q2", "f2")
    status = F.when(F.col("q") == F.col("q2"), "same").when(F.col("f") != F.col("f2"), "changed").otherwise("conflict")
    return a.join(b, "l_orderkey").filter("i < j AND p != p2").select("l_orderkey", "i", "j", status.alias("status"))


@register("join_plan_coverage", "WITH plan AS (SELECT s.l_suppkey, m.month, f.l_returnflag FROM (SELECT DISTINCT l_suppkey FROM lineitem) s, (SELECT unnest([0, 3, 6, 9, 12]) AS month) m, (SELECT DISTINCT l_returnflag FROM lineitem) f) SELECT * FROM plan p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = p.l_suppkey AND l.l_returnflag = p.l_returnflag AND (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 = p.month)")
def join_plan_coverage(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_suppkey", "l_returnflag", ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("month"))
    flags = rows.agg(F.collect_set("l_returnflag").alias("flags"))  # one row
    plan = rows.select("l_suppkey").distinct().crossJoin(F.broadcast(flags)).select("l_suppkey", F.explode("flags").alias("l_returnflag"), F.lit([0, 3, 6, 9, 12]).alias("ms"))
    return plan.select("l_suppkey", "l_returnflag", F.explode("ms").alias("month")).join(rows, ["l_suppkey", "l_returnflag", "month"], "left_anti")


@register("win_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win_latest(spark: SparkSession, root: str) -> DataFrame:
    return R.nth_per(table(spark, root, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("win_dedupe_key", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus, l_shipdate ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def win_dedupe_key(spark: SparkSession, root: str) -> DataFrame:
    return R.nth_per(table(spark, root, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"], [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber")


@register("win_dedupe_text", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left(text, 120) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def win_dedupe_text(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", F.xxhash64(F.substring("text", 1, 120)).alias("h"), F.substring("text", 1, 120).alias("head"))
    return R.nth_per(rows, ["h", "head"], [F.col("doc_id")]).select("doc_id")


@register("win_dedupe_evidence", "SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate' ELSE 'judged' END AS verdict FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS n FROM documents)")
def win_dedupe_evidence(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("source", "h").orderBy("doc_id"))
    return rows.select("doc_id", F.when(nth > 1, "duplicate").otherwise("judged").alias("verdict"))


@register("win_dedupe_material", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source || '::' || left(text, 120) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND trim(text) <> ''")
def win_dedupe_material(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").filter(F.trim("text") != "").select("doc_id", F.concat("source", F.lit("::"), F.substring("text", 1, 120)).alias("k"))
    return R.nth_per(rows, ["k"], [F.col("doc_id")]).select("doc_id")


@register("win_carry_forward", "SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('click', 'view') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS carried FROM events")
def win_carry_forward(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").withColumn("carried", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))
    return R.carry_forward(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "carried").select("event_id", "carried")


@register("win_session_group", "SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS c FROM events)")
def win_session_group(spark: SparkSession, root: str) -> DataFrame:
    return R.islands(table(spark, root, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "island")


@register("win_cap_per_group", "SELECT source, doc_id, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def win_cap_per_group(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("source", "lang", "doc_id", "n_chars")
    return R.nth_per(rows, ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")], 3, "n").select("source", "doc_id", F.col("n").cast("long").alias("n"))


@register("win_series_ends", "SELECT l_suppkey, l_returnflag, first(l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS first_value, last(l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS last_value FROM lineitem GROUP BY ALL")
def win_series_ends(spark: SparkSession, root: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, root, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min_by("l_quantity", at).alias("first_value"), F.max_by("l_quantity", at).alias("last_value"))


@register("stb_trend", "WITH s AS (SELECT l_suppkey, l_returnflag, count(*) AS n, first(l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS a, last(l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS b FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, CASE WHEN n < 2 THEN 'insufficient' WHEN abs(b - a) < 1e-12 THEN 'flat' WHEN b > a THEN 'up' ELSE 'down' END AS trend FROM s")
def stb_trend(spark: SparkSession, root: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    ends = table(spark, root, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min_by("l_quantity", at).alias("a"), F.max_by("l_quantity", at).alias("b"))
    trend = F.when(F.col("n") < 2, "insufficient").when(F.abs(F.col("b") - F.col("a")) < 1e-12, "flat").when(F.col("b") > F.col("a"), "up").otherwise("down")
    return ends.select("l_suppkey", "l_returnflag", trend.alias("trend"))


@register("stb_conflict", "SELECT l_suppkey, l_shipdate, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1")
def stb_conflict(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.count_distinct("l_quantity").alias("n")).filter("n > 1")


@register("win_baseline_delta", "WITH b AS (SELECT l_suppkey, l_returnflag, min(l_shipdate) AS d FROM lineitem GROUP BY ALL), v AS (SELECT l.l_suppkey, l.l_returnflag, min(l_quantity) AS base FROM lineitem l JOIN b ON l.l_suppkey = b.l_suppkey AND l.l_returnflag = b.l_returnflag AND l_shipdate = d GROUP BY ALL HAVING count(DISTINCT l_quantity) = 1) SELECT l_orderkey, l_linenumber, l_quantity - base AS delta FROM lineitem LEFT JOIN v USING (l_suppkey, l_returnflag)")
def win_baseline_delta(spark: SparkSession, root: str) -> DataFrame:
    """Difference from the value at the first time point of the series; null when that point has several values."""
    w = Window.partitionBy("l_suppkey", "l_returnflag")
    rows = table(spark, root, "lineitem").withColumn("at0", F.col("l_shipdate") == F.min("l_shipdate").over(w))
    low, high = (f(F.when(F.col("at0"), F.col("l_quantity"))).over(w) for f in (F.min, F.max))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - F.when(low == high, low)).alias("delta"))


@register("win_log_ring", "SELECT user_id, greatest(count(*) - 20, 0) AS log_offset, least(count(*), 20) AS kept FROM events GROUP BY user_id")
def win_log_ring(spark: SparkSession, root: str) -> DataFrame:
    n = F.count("*")
    return table(spark, root, "events").groupBy("user_id").agg(F.greatest(n - 20, F.lit(0)).alias("log_offset"), F.least(n, F.lit(20)).alias("kept"))


@register("win_cursor", "WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) SELECT user_id, event_id, seq, max(seq) OVER (PARTITION BY user_id) + 1 AS next_cursor FROM s WHERE seq >= 50")
def win_cursor(spark: SparkSession, root: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = table(spark, root, "events").select("user_id", "event_id", seq.alias("seq")).filter("seq >= 50")
    return rows.withColumn("next_cursor", F.max("seq").over(Window.partitionBy("user_id")) + 1)


@register("win_greedy_budget", """WITH RECURSIVE items AS (SELECT source, doc_id, n_chars AS size, left(text, 120) AS sig, row_number() OVER (PARTITION BY source ORDER BY -doc_id % 7, n_chars, doc_id) AS nth FROM documents WHERE n_chars <= 2400),
walk AS (SELECT DISTINCT source, 0::BIGINT AS nth, 0::BIGINT AS used, []::VARCHAR[] AS sigs, []::VARCHAR[] AS ids FROM items UNION ALL
SELECT source, nth, CASE WHEN fits THEN used + size ELSE used END, CASE WHEN fits THEN list_append(sigs, sig) ELSE sigs END, CASE WHEN fits THEN list_append(ids, doc_id::VARCHAR) ELSE ids END
FROM (SELECT w.source, i.nth, w.used, w.sigs, w.ids, i.size, i.sig, i.doc_id, len(w.ids) < 10 AND w.used + i.size <= 2400 AND NOT list_contains(w.sigs, i.sig) AS fits FROM walk w JOIN items i ON i.source = w.source AND i.nth = w.nth + 1))
SELECT source, array_to_string(max_by(ids, nth), ',') AS picked FROM walk GROUP BY source""")
def win_greedy_budget(spark: SparkSession, root: str) -> DataFrame:
    """Per source: documents by score descending, shorter first among equals, within 10 items and 2400 characters."""
    rows = table(spark, root, "documents").select("source", F.struct((-F.col("doc_id") % 7).alias("o"), "n_chars", F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.substring("text", 1, 120).alias("sig")).alias("x"))
    grouped = rows.filter("x.size <= 2400").groupBy("source").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select("source", F.array_join(R.greedy_budget(F.col("xs"), 10, 2400).cast("array<string>"), ",").alias("picked"))


@register("srt_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 20 OFFSET 20")
def srt_page(spark: SparkSession, root: str) -> DataFrame:
    return R.page(table(spark, root, "customer").select("c_custkey", "c_name"), [F.desc("c_custkey")], 2, 20)


@register("srt_page_clamped", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 200")
def srt_page_clamped(spark: SparkSession, root: str) -> DataFrame:
    return R.page(table(spark, root, "customer").select("c_custkey"), [F.desc("c_custkey")], 0, 5000, 200)


@register("agg_page_total", "SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM customer")
def agg_page_total(spark: SparkSession, root: str) -> DataFrame:
    return R.page_total(table(spark, root, "customer"), 20)


@register("srt_doc_chunks", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 1000000000)) AS pos FROM conversations")
def srt_doc_chunks(spark: SparkSession, root: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.coalesce("turn", F.lit(1_000_000_000))))
    return table(spark, root, "conversations").select("conv_id", "turn", pos.cast("long").alias("pos"))


@register("set_union_ids", "SELECT id, min(o) AS arrival FROM (SELECT vec_id AS id, vec_id AS o FROM embeddings UNION ALL SELECT doc_id, 1000000000 + doc_id FROM labels) GROUP BY id")
def set_union_ids(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("o"))
    b = table(spark, root, "labels").select(F.col("doc_id").alias("id"), (F.lit(1_000_000_000) + F.col("doc_id")).alias("o"))
    return a.union(b).groupBy("id").agg(F.min("o").alias("arrival"))


@register("set_intersect", "SELECT vec_id AS id FROM embeddings INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id")).intersect(table(spark, root, "labels").select("doc_id"))


@register("set_except", "SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM labels")
def set_except(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id")).subtract(table(spark, root, "labels").select("doc_id"))


@register("set_sync_rules", "SELECT coalesce(vec_id, doc_id) AS id, CASE WHEN doc_id IS NULL THEN 'delete' WHEN vec_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM embeddings FULL JOIN labels ON vec_id = doc_id")
def set_sync_rules(spark: SparkSession, root: str) -> DataFrame:
    have = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("have"))
    want = table(spark, root, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("want"))
    action = F.when(F.col("want").isNull(), "delete").when(F.col("have").isNull(), "insert").otherwise("update")
    return have.join(want, "id", "full_outer").select("id", action.alias("action"))


_KEYS = "SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS k FROM documents"


@register("set_symdiff_keys", f"WITH w AS ({_KEYS}), p AS (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), added AS (SELECT doc_id - 1 AS doc_id, string_agg(k, ',' ORDER BY k) AS added FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.doc_id = x.doc_id - 1 AND y.k = x.k) GROUP BY ALL), removed AS (SELECT doc_id, string_agg(k, ',' ORDER BY k) AS removed FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.doc_id = x.doc_id + 1 AND y.k = x.k) GROUP BY ALL) SELECT doc_id, coalesce(added, '') AS added, coalesce(removed, '') AS removed FROM p LEFT JOIN added USING (doc_id) LEFT JOIN removed USING (doc_id)")
def set_symdiff_keys(spark: SparkSession, root: str) -> DataFrame:
    keys = table(spark, root, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("a"))
    nxt = keys.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    diff = lambda x, y: F.array_join(F.sort_array(F.array_except(x, y)), ",")
    return keys.join(nxt, "doc_id").select("doc_id", diff("b", "a").alias("added"), diff("a", "b").alias("removed"))


@register("src_es_get", "SELECT doc_id, lang FROM documents WHERE doc_id = 42")
def src_es_get(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter("doc_id = 42").select("doc_id", "lang")


@register("src_es_match", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'example') ORDER BY doc_id LIMIT 6")
def src_es_match(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter(F.lower("text").contains("example")).orderBy("doc_id").limit(6).select("doc_id", "source")


@register("src_vector_scan", "SELECT vec_id, label FROM embeddings WHERE label = 1")
def src_vector_scan(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").filter("label = 1").select("vec_id", "label")


@register("snk_vector_upsert", "SELECT id, last(label ORDER BY o) AS label FROM (SELECT vec_id AS id, label, 0 AS o FROM embeddings UNION ALL SELECT doc_id, quality, 1 FROM labels) GROUP BY id")
def snk_vector_upsert(spark: SparkSession, root: str) -> DataFrame:
    old = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit(0).alias("o"))
    new = table(spark, root, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.lit(1).alias("o"))
    return old.union(new).groupBy("id").agg(F.max_by("label", "o").alias("label"))


@register("snk_vector_delete", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def snk_vector_delete(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, root, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")


@register("snk_es_update", "SELECT vec_id, CASE WHEN label = 2 THEN 99 ELSE label END AS label FROM embeddings")
def snk_es_update(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.when(F.col("label") == 2, 99).otherwise(F.col("label")).alias("label"))
