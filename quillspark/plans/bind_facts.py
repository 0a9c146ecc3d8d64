"""Queries of facts, forms, rules in scope, spatial and catalogue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as T
from quillspark.operators import limits
from quillspark.operators import relational as R
from quillspark.plans.registry import register
from quillspark.sources.tables import table


@register("flt_submission", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true) AND source <> 'src0'")
def flt_submission(spark: SparkSession, root: str) -> DataFrame:
    """Enabled unless said otherwise, and no reference material."""
    rows = table(spark, root, "documents").select("doc_id", "source").join(table(spark, root, "labels"), "doc_id", "left")
    return rows.filter(F.coalesce(F.col("quality") == 1, F.lit(True)) & (F.col("source") != "src0")).select("doc_id")


@register("flt_experience", "SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'signup') AND CASE event_type WHEN 'click' THEN user_id = 7 WHEN 'view' THEN user_id = 9 ELSE true END")
def flt_experience(spark: SparkSession, root: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("user_id")
    scope = F.when(kind == "click", key == 7).when(kind == "view", key == 9).when(kind == "signup", True).otherwise(False)
    return table(spark, root, "events").filter(kind.isin("click", "view", "signup") & scope).select("event_id")


@register("flt_example", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND (event_type = 'view' OR json_extract_string(props, '$.k') IS NOT NULL)")
def flt_example(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, root, "events").filter(kind.isin("view", "click") & ((kind == "view") | F.get_json_object("props", "$.k").isNotNull())).select("event_id")


@register("flt_stability_doc", "SELECT doc_id FROM documents WHERE source = 'src4' OR contains(lang, 'de') OR contains(left(text, 200), 'stable')")
def flt_stability_doc(spark: SparkSession, root: str) -> DataFrame:
    tags = F.array("source", "lang")
    named = F.exists(tags, lambda t: (t == "src4") | t.contains("de"))
    return table(spark, root, "documents").filter(named | F.substring("text", 1, 200).contains("stable")).select("doc_id")


@register("win_dedupe_finding", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, json_extract_string(props, '$.k')")
def win_dedupe_finding(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return R.nth_per(rows, ["user_id", "event_type", "k"], [F.col("event_id")]).select("event_id")


@register("win_vmerge_fill", "WITH g AS (SELECT *, count_if(event_type IN ('purchase', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events) SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS filled FROM g")
def win_vmerge_fill(spark: SparkSession, root: str) -> DataFrame:
    """Cells take what the restart cell above them holds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, root, "events").withColumn("grp", F.count_if(F.col("event_type").isin("purchase", "error")).over(order))
    return rows.select("event_id", F.first("event_type").over(Window.partitionBy("user_id", "grp").orderBy("ts", "event_id")).alias("filled"))


@register("win_baseline_share", "WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-06-01'), o AS (SELECT DISTINCT l_suppkey, l_linestatus FROM lineitem) SELECT l_suppkey, l_linestatus, l_orderkey, l_linenumber FROM b JOIN o USING (l_suppkey)")
def win_baseline_share(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the first months belong to every orientation of their batch."""
    rows = table(spark, root, "lineitem")
    first = rows.filter(F.col("l_shipdate").cast("date") < F.lit("1992-06-01").cast("date")).select("l_suppkey", "l_orderkey", "l_linenumber")
    return first.join(rows.select("l_suppkey", "l_linestatus").distinct(), "l_suppkey").select("l_suppkey", "l_linestatus", "l_orderkey", "l_linenumber")


@register("stb_scalar", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS value FROM lineitem")
def stb_scalar(spark: SparkSession, root: str) -> DataFrame:
    """Only an exact single number counts: no comparator, no list."""
    n = F.col("l_quantity").cast("decimal(10,2)").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(n, F.lit(" mg"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("<"), n)).otherwise(F.concat(n, F.lit(", "), n))
    q = limits.quantity(limits.normalise(said))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.when(q["low"] == q["high"], q["low"]).cast("double").alias("value"))


@register("stb_unit_convert", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 0.001 WHEN 1 THEN p_size * 0.000001 END::DOUBLE AS base FROM part")
def stb_unit_convert(spark: SparkSession, root: str) -> DataFrame:
    """To the base of the unit's dimension; null for unknown units."""
    unit = F.element_at(F.array(F.lit("mg/g"), F.lit("ug/g"), F.lit("widgets")), (F.col("p_size") % 3 + 1).cast("int"))
    factor = limits._lookup(unit, 1).cast("decimal(18,9)")
    return table(spark, root, "part").select("p_partkey", (F.col("p_size").cast("decimal(18,9)") * factor).cast("double").alias("base"))


@register("str_nfkc", "SELECT p_partkey, p_size || 'mg/ml' AS shown FROM part")
def str_nfkc(spark: SparkSession, root: str) -> DataFrame:
    """Full-width forms and sign variants become plain ones."""
    wide = F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９")
    return table(spark, root, "part").select("p_partkey", limits.normalise(F.concat(wide, F.lit("ｍｇ／ｍＬ"))).alias("w")).select("p_partkey", F.lower("w").alias("shown"))


@register("dt_month_list", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size, p_size % 7, 12])), ',') AS months FROM part")
def dt_month_list(spark: SparkSession, root: str) -> DataFrame:
    """All months of lists like 3、6、12月, sorted and distinct."""
    said = F.concat(F.lit("考察"), F.concat_ws("、", F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string"), F.lit("12")), F.lit("月"))
    found = F.regexp_extract_all(F.regexp_extract(said, r"((?:\d+、)*\d+)月", 1), F.lit(r"\d+"), F.lit(0)).cast("array<int>")
    return table(spark, root, "part").select("p_partkey", F.array_join(F.sort_array(F.array_distinct(found)).cast("array<string>"), ",").alias("months"))


_LABELLED_CODE = r"(?:统一社会信用代码/组织机构代码|统一社会信用代码|社会信用代码)[:：;\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*([0-9A-Z]{15,25})"
_BARE_CODE = r"(?:^|[^\p{L}\p{N}_])([0-9A-Z]{18})(?:[^\p{L}\p{N}_]|\z)"


@register("str_credit_code", f"SELECT page_id, coalesce(nullif(regexp_extract(html, '{_LABELLED_CODE}', 1), ''), nullif(regexp_extract(html, '{_BARE_CODE}', 1), ''), regexp_extract(upper(html), '[0-9A-Z]{{18,}}', 0)) AS code FROM pages")
def str_credit_code(spark: SparkSession, root: str) -> DataFrame:
    """The 15 to 25 figures and capitals after a label; else the first word of exactly 18; else the first run of 18 or more, whatever its case.

    The first two steps are the reference's, with word characters and white space of any script. It has no third one and leaves such texts without a code.
    That one is upper-cased a code point at a time, as in SQL: an ß or a ligature doesn't become two letters; besides a to z only ı and ſ have a capital in A to Z.
    """
    first = lambda pattern: F.get(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.lit(0))
    run = F.regexp_extract("html", r"[0-9A-Za-zıſ]{18,}", 0)
    code = F.coalesce(first(_LABELLED_CODE), first(_BARE_CODE), F.upper(F.translate(run, "ıſ", "IS")))
    return table(spark, root, "pages").select("page_id", code.alias("code"))


@register("join_spatial", "SELECT a.p_partkey AS outer_id, b.p_partkey AS inner_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_size - 5 <= b.p_size - 2 AND a.p_size + 5 >= b.p_size + 2 AND a.p_retailprice - 50 <= b.p_retailprice - 10 AND a.p_retailprice + 50 >= b.p_retailprice + 10")
def join_spatial(spark: SparkSession, root: str) -> DataFrame:
    """Boxes of one page that hold another box, met by the grid cell of the inner one's corner."""
    box = lambda dx, dy, *names: [(F.col("p_size") - dx).alias(names[0]), (F.col("p_size") + dx).alias(names[1]), (F.col("p_retailprice") - dy).alias(names[2]), (F.col("p_retailprice") + dy).alias(names[3])]
    rows = table(spark, root, "part")
    a = rows.select("p_brand", F.col("p_partkey").alias("outer_id"), *box(5, 50, "x0", "x1", "y0", "y1"))
    b = rows.select("p_brand", F.col("p_partkey").alias("inner_id"), *box(2, 10, "u0", "u1", "v0", "v1"))
    return R.box_join(a, b, ["p_brand"], 10.0, 100.0).filter("outer_id != inner_id").select("outer_id", "inner_id")


@register("cls_nearest_section", "WITH s AS (SELECT p_partkey, (p_size // 10) || '.' || (p_size % 10) || '.' || (p_partkey % 3) AS id FROM part), legal AS (SELECT unnest(['1', '2.3', '4', '3.1.2', '0.5']) AS id) SELECT p_partkey, max_by(legal.id, length(legal.id)) AS section FROM s JOIN legal ON s.id = legal.id OR starts_with(s.id, legal.id || '.') GROUP BY p_partkey")
def cls_nearest_section(spark: SparkSession, root: str) -> DataFrame:
    """Climb dotted prefixes until one is a legal section: an equi-join on the prefixes of each id."""
    legal = spark.createDataFrame([("1",), ("2.3",), ("4",), ("3.1.2",), ("0.5",)], "section string")
    parts = F.array(F.expr("cast(p_size div 10 as string)"), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    climbed = table(spark, root, "part").select("p_partkey", F.explode(prefixes).alias("section"))
    return climbed.join(F.broadcast(legal), "section").groupBy("p_partkey").agg(F.max_by("section", F.length("section")).alias("section"))


@register("frm_merge", "SELECT coalesce(a.doc_id, b.vec_id) AS path, CASE WHEN a.toxic = 1 THEN 'manual' WHEN a.doc_id IS NULL OR b.label > a.quality THEN 'candidate' ELSE 'current' END AS origin, CASE WHEN a.toxic = 1 THEN a.quality WHEN a.doc_id IS NULL OR b.label > a.quality THEN b.label ELSE a.quality END AS value FROM labels a FULL JOIN embeddings b ON a.doc_id = b.vec_id")
def frm_merge(spark: SparkSession, root: str) -> DataFrame:
    """Manual values stay; a candidate wins where nothing is known or its confidence is higher."""
    a = table(spark, root, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("v"), (F.col("toxic") == 1).alias("manual"))
    b = table(spark, root, "embeddings").select(F.col("vec_id").alias("path"), F.col("label").alias("c"))
    origin = F.when(F.col("manual"), "manual").when(F.col("v").isNull() | (F.col("c") > F.col("v")), "candidate").otherwise("current")
    return a.join(b, "path", "full_outer").withColumn("origin", origin).select("path", "origin", F.when(F.col("origin") == "candidate", F.col("c")).otherwise(F.col("v")).alias("value"))


@register("frm_cross_check", "SELECT c_custkey, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n = c_nationkey THEN 'equal' ELSE 'different' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def frm_cross_check(spark: SparkSession, root: str) -> DataFrame:
    other = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == F.col("c_nationkey"), "equal").otherwise("different")
    return table(spark, root, "customer").select("c_custkey", "c_nationkey").join(other, "c_custkey", "left").select("c_custkey", status.alias("status"))


@register("num_confirm", "SELECT doc_id, CASE WHEN n = 1 AND quality = 1 THEN 'confirmed' WHEN n = 1 THEN 'text differs' ELSE 'ambiguous' END AS state FROM (SELECT l.doc_id, l.quality, count(*) OVER (PARTITION BY d.source, d.n_chars) AS n FROM labels l JOIN documents d USING (doc_id))")
def num_confirm(spark: SparkSession, root: str) -> DataFrame:
    """A confirmation counts only if its key is unique and the text is the one it was made for."""
    rows = table(spark, root, "labels").join(table(spark, root, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    n = F.count("*").over(Window.partitionBy("source", "n_chars"))
    rows = rows.withColumn("n", n)
    return rows.select("doc_id", F.when((F.col("n") == 1) & (F.col("quality") == 1), "confirmed").when(F.col("n") == 1, "text differs").otherwise("ambiguous").alias("state"))


@register("agg_feedback_total", "SELECT count_if(event_type = 'click') AS chains, count_if(event_type = 'error') AS errors, round(count_if(event_type = 'error') / count(*), 6) AS error_rate, round(count_if(event_type = 'purchase' AND value > 50) / nullif(count_if(event_type = 'purchase'), 0), 6) AS modification_rate FROM events")
def agg_feedback_total(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    bought = F.count_if(kind == "purchase")
    return table(spark, root, "events").agg(F.count_if(kind == "click").alias("chains"), F.count_if(kind == "error").alias("errors"), F.round(N.ratio0(F.count_if(kind == "error"), F.count("*")), 6).alias("error_rate"), F.round(N.ratio0(F.count_if((kind == "purchase") & (F.col("value") > 50)), bought), 6).alias("modification_rate"))


@register("rag_gssc", "SELECT source, left(string_agg(left(text, 200), chr(10) ORDER BY n_chars DESC, doc_id), 1600) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10 GROUP BY source")
def rag_gssc(spark: SparkSession, root: str) -> DataFrame:
    """Gathered, cut to ten items, joined and cut at 1600 characters."""
    rows = table(spark, root, "documents").select("source", "n_chars", "doc_id", F.substring("text", 1, 200).alias("t"))
    top = R.nth_per(rows, ["source"], [F.desc("n_chars"), F.col("doc_id")], 10, "n")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n")
    return top.groupBy("source").agg(F.substring(joined, 1, 1600).alias("context"))


@register("snk_parsed_json", "SELECT 0 AS part, source AS id, count(*)::VARCHAR AS body FROM documents GROUP BY source UNION ALL SELECT 1, doc_id::VARCHAR, lang FROM documents UNION ALL SELECT 2, page_id::VARCHAR, '' FROM pages WHERE trim(html) = ''")
def snk_parsed_json(spark: SparkSession, root: str) -> DataFrame:
    """Rows of an artifact: summaries, then chunks, then pages without text."""
    docs = table(spark, root, "documents")
    a = docs.groupBy(F.col("source").alias("id")).agg(F.count("*").cast("string").alias("body")).select(F.lit(0).alias("part"), "id", "body")
    b = docs.select(F.lit(1).alias("part"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("body"))
    c = table(spark, root, "pages").filter(T.strip(F.col("html")) == "").select(F.lit(2).alias("part"), F.col("page_id").cast("string").alias("id"), F.lit("").alias("body"))
    return a.unionByName(b).unionByName(c)
