"""Queries of metrics, retrieval, evidence, stability and task operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as T
from quillspark.functions.vectors import cosine
from quillspark.operators import limits, metrics, retrieval, review, stability, tasks
from quillspark.operators import relational as R
from quillspark.plans.registry import register
from quillspark.sources.tables import table

_KIND = "CASE WHEN quality = 1 AND toxic = 0 THEN 'valid' WHEN quality = 1 THEN 'false_positive' ELSE 'missed' END"


def _feedback(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "valid").when(F.col("quality") == 1, "false_positive").otherwise("missed")
    return table(spark, root, "labels").select("doc_id", kind.alias("kind"))


@register("agg_confusion", f"WITH k AS (SELECT source, {_KIND} AS kind FROM labels JOIN documents USING (doc_id)), c AS (SELECT source, count_if(kind = 'valid') AS tp, count_if(kind = 'false_positive') AS fp, count_if(kind = 'missed') AS fn FROM k GROUP BY 1), m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT source, tp, fp, fn, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall FROM m")
def agg_confusion(spark: SparkSession, root: str) -> DataFrame:
    rows = _feedback(spark, root).join(table(spark, root, "documents").select("doc_id", "source"), "doc_id")
    return metrics.confusion(rows, ["source"], "kind").select("source", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("agg_reward", f"WITH k AS (SELECT source, {_KIND} AS kind FROM labels JOIN documents USING (doc_id)), c AS (SELECT source, count_if(kind = 'valid') AS tp, count_if(kind = 'false_positive') AS fp, count_if(kind = 'missed') AS fn FROM k GROUP BY 1), m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, tp + fp + fn AS n FROM c) SELECT source, round(greatest(0, least(1, 0.35 * coalesce(2 * p * r / nullif(p + r, 0), 0) + 0.25 * tp / n + 0.2 * p + 0.2 * r - 0.1 * fp / n - 0.2 * fn / n)), 6) AS reward_score FROM m")
def agg_reward(spark: SparkSession, root: str) -> DataFrame:
    rows = _feedback(spark, root).join(table(spark, root, "documents").select("doc_id", "source"), "doc_id")
    return metrics.confusion(rows, ["source"], "kind").select("source", F.round("reward_score", 6).alias("reward_score"))


_WORDS_A, _WORDS_B = "list_distinct(string_split(a.text, ' '))", "list_distinct(string_split(b.text, ' '))"


def _case_sets(spark: SparkSession, root: str) -> DataFrame:
    """Each document's words against those of the next one, as expected and actual findings."""
    own = table(spark, root, "documents").select("doc_id", "lang", F.array_distinct(F.split("text", " ")).alias("a"))
    nxt = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("lang2"), F.col("a").alias("b"))
    return own.join(nxt, "doc_id")


@register("agg_retrieval_case", f"SELECT a.doc_id, len(list_intersect({_WORDS_A}, {_WORDS_B})) AS tp, len({_WORDS_B}) - len(list_intersect({_WORDS_A}, {_WORDS_B})) AS fp, len({_WORDS_A}) - len(list_intersect({_WORDS_A}, {_WORDS_B})) AS fn FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def agg_retrieval_case(spark: SparkSession, root: str) -> DataFrame:
    s = metrics.set_scores(F.col("a"), F.col("b"))
    return _case_sets(spark, root).select("doc_id", *[s[k].alias(k) for k in ("tp", "fp", "fn")])


@register("agg_retrieval_total", f"WITH c AS (SELECT len(list_intersect({_WORDS_A}, {_WORDS_B})) AS tp, len({_WORDS_A}) AS na, len({_WORDS_B}) AS nb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT sum(tp)::BIGINT AS tp, round(sum(tp) / sum(nb), 6) AS precision, round(sum(tp) / sum(na), 6) AS recall, round(sum(tp) / sum(na + nb - tp), 6) AS accuracy FROM c")
def agg_retrieval_total(spark: SparkSession, root: str) -> DataFrame:
    s = metrics.set_scores(F.col("a"), F.col("b"))
    total = _case_sets(spark, root).select(*[s[k].alias(k) for k in ("tp", "fp", "fn")]).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select("tp", F.round(N.ratio0(tp, tp + fp), 6).alias("precision"), F.round(N.ratio0(tp, tp + fn), 6).alias("recall"), F.round(N.ratio0(tp, tp + fp + fn), 6).alias("accuracy"))


@register("agg_review_case", f"WITH c AS (SELECT a.doc_id, a.lang = b.lang AS cm, a.source = b.source AS rm, len(list_intersect({_WORDS_A}, {_WORDS_B})) AS tp, len({_WORDS_A}) AS na, len({_WORDS_B}) AS nb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 0.55 * cm::INT + 0.15 * rm::INT + 0.3 * coalesce(2.0 * tp / (na + nb), 0) END, 6) AS composite FROM c")
def agg_review_case(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "documents").select("doc_id", "source")
    rows = _case_sets(spark, root).join(own, "doc_id").join(own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("source2")), "doc_id")
    f = metrics.set_scores(F.col("a"), F.col("b"))["f1"]
    score = metrics.review_case(F.col("doc_id") % 10 != 0, F.col("lang") == F.col("lang2"), F.col("source") == F.col("source2"), f, f)
    return rows.select("doc_id", F.round(score, 6).alias("composite"))


@register("agg_version_gain", "WITH b AS (SELECT doc_id, quality::DOUBLE AS s FROM labels WHERE doc_id % 5 <> 0), c AS (SELECT doc_id, (1 - toxic)::DOUBLE AS s FROM labels WHERE doc_id % 5 <> 1), j AS (SELECT coalesce(c.s, 0) - coalesce(b.s, 0) AS d FROM b FULL JOIN c USING (doc_id)), t AS (SELECT count_if(d > 1e-9) AS wins, count_if(d < -1e-9) AS losses, count_if(abs(d) <= 1e-9) AS ties, (SELECT avg(s) FROM c) - (SELECT avg(s) FROM b) AS delta FROM j) SELECT wins, losses, ties, round(delta, 6) AS delta, CASE WHEN delta > 1e-9 AND losses = 0 THEN 'candidate_preferred' WHEN delta < -1e-9 OR losses > wins THEN 'candidate_rejected' ELSE 'manual_review_required' END AS recommendation FROM t")
def agg_version_gain(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "labels")
    b = rows.filter("doc_id % 5 != 0").select("doc_id", F.col("quality").cast("double").alias("s"))
    c = rows.filter("doc_id % 5 != 1").select("doc_id", (1 - F.col("toxic")).cast("double").alias("s"))
    return metrics.version_gain(b, c, "doc_id", "s").withColumn("delta", F.round("delta", 6))


@register("join_version_full", "SELECT coalesce(b.doc_id, c.doc_id) AS case_id, coalesce(b.quality, 0) AS baseline, coalesce(1 - c.toxic, 0) AS candidate FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) b FULL JOIN (SELECT * FROM labels WHERE doc_id % 5 <> 1) c ON b.doc_id = c.doc_id")
def join_version_full(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "labels")
    b = rows.filter("doc_id % 5 != 0").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("baseline"))
    c = rows.filter("doc_id % 5 != 1").select(F.col("doc_id").alias("case_id"), (1 - F.col("toxic")).alias("candidate"))
    return b.join(c, "case_id", "full_outer").fillna(0)


@register("agg_ablation_rank", "SELECT event_type AS variant, round(0.7 * avg(value) + 0.3 * max(value), 6) AS score, row_number() OVER (ORDER BY round(0.7 * avg(value) + 0.3 * max(value), 6) DESC, event_type) AS rank FROM events GROUP BY event_type")
def agg_ablation_rank(spark: SparkSession, root: str) -> DataFrame:
    scored = table(spark, root, "events").groupBy(F.col("event_type").alias("variant")).agg(F.round(0.7 * F.avg("value") + 0.3 * F.max("value"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "variant")).cast("long"))


@register("agg_section_overview", "SELECT source AS section, max(lang) AS code, sum(length(text))::BIGINT AS chars, max(left(text, 320)) AS preview FROM documents GROUP BY source")
def agg_section_overview(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(F.col("source").alias("section")).agg(F.max("lang").alias("code"), F.sum(F.length("text")).alias("chars"), F.max(F.substring("text", 1, 320)).alias("preview"))


@register("agg_section_stats", "SELECT count(DISTINCT source) AS sections, count_if(length(text) > 0) AS units, sum(length(text))::BIGINT AS chars FROM documents")
def agg_section_stats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").agg(F.count_distinct("source").alias("sections"), F.count_if(F.length("text") > 0).alias("units"), F.sum(F.length("text")).alias("chars"))


@register("agg_count_by_parent", "SELECT o_custkey, count(*) AS files FROM orders GROUP BY 1")
def agg_count_by_parent(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").groupBy("o_custkey").agg(F.count("*").alias("files"))


@register("agg_breakdown", "SELECT 'type' AS dimension, coalesce(event_type, 'unknown') AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', coalesce(user_id::VARCHAR, '-'), count(*) FROM events GROUP BY 2")
def agg_breakdown(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select(F.explode(F.array(F.struct(F.lit("type").alias("dimension"), F.coalesce("event_type", F.lit("unknown")).alias("value")), F.struct(F.lit("user").alias("dimension"), F.coalesce(F.col("user_id").cast("string"), F.lit("-")).alias("value")))).alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


@register("agg_signal", "SELECT lang, count_if(quality = 0) AS incorrect, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def agg_signal(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "lang", "source").join(table(spark, root, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("incorrect"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@register("agg_exact_match", "SELECT round(avg((trim(a.lang) = trim(b.lang))::INT), 6) AS exact_match FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def agg_exact_match(spark: SparkSession, root: str) -> DataFrame:
    return _case_sets(spark, root).agg(F.round(F.avg((F.trim("lang") == F.trim("lang2")).cast("int")), 6).alias("exact_match"))


@register("agg_group_docs", "SELECT conv_id, array_to_string(list(turn ORDER BY turn), ',') AS turns, first(role ORDER BY turn) AS first_role FROM conversations GROUP BY conv_id")
def agg_group_docs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"), F.min_by("role", "turn").alias("first_role"))
    return rows.select("conv_id", F.array_join(F.col("t").cast("array<string>"), ",").alias("turns"), "first_role")


@register("agg_status_fold", "WITH s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN '通过' WHEN 'signup' THEN CASE WHEN event_id % 40 = 0 THEN '证据不足' ELSE '不适用' END WHEN 'error' THEN CASE WHEN event_id % 90 = 0 THEN '发现问题' ELSE '不适用' END ELSE '不适用' END AS s FROM events) SELECT user_id, CASE WHEN bool_or(s = '发现问题') THEN '发现问题' WHEN bool_or(s = '证据不足') THEN '证据不足' WHEN bool_and(s = '不适用') THEN '不适用' ELSE '通过' END AS status FROM s GROUP BY 1")
def agg_status_fold(spark: SparkSession, root: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "purchase", review.PASSED).when((kind == "signup") & (n % 40 == 0), review.LACKING).when((kind == "error") & (n % 90 == 0), review.PROBLEM).otherwise(review.NOT_APPLICABLE)
    return table(spark, root, "events").select("user_id", status.alias("s")).groupBy("user_id").agg(review.fold_status("s").alias("status"))


@register("agg_kleene_and", "SELECT l_suppkey, CASE WHEN count_if(NOT f) > 0 THEN false WHEN count_if(f) = count(*) THEN true END AS flag FROM (SELECT l_suppkey, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity < 50 END AS f FROM lineitem) GROUP BY 1")
def agg_kleene_and(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_suppkey", F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_quantity") < 50).alias("f"))
    return rows.groupBy("l_suppkey").agg(limits.kleene_and("f").alias("flag"))


@register("agg_all_explicit", "SELECT l_suppkey, bool_and(f) AS flag FROM (SELECT l_suppkey, CASE WHEN l_tax > 0.05 THEN l_quantity < 50 END AS f FROM lineitem) GROUP BY 1")
def agg_all_explicit(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.bool_and(F.when(F.col("l_tax") > 0.05, F.col("l_quantity") < 50)).alias("flag"))


@register("stb_evaluate", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 2 THEN l_quantity::INT * 1000 <= 30000 ELSE l_quantity::INT <= 30 END AS within, CASE WHEN l_linenumber % 4 = 3 THEN 'missing_unit' WHEN l_quantity::INT <= 30 THEN 'numeric_within_limit' ELSE 'numeric_out_of_limit' END AS reason FROM lineitem")
def stb_evaluate(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    result = F.when(F.col("l_linenumber") % 4 == 3, q.cast("string")).when(F.col("l_linenumber") % 4 == 2, F.concat((q * 1000).cast("string"), F.lit("ug/ml"))).otherwise(F.concat(q.cast("string"), F.lit(" mg/ml")))
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", result.alias("r"), F.lit("不大于30mg/ml").alias("m"))
    return limits.evaluate(rows, "r", "m").select("l_orderkey", "l_linenumber", F.col("decision.within").alias("within"), F.col("decision.reason").alias("reason"))


@register("agg_limit_check", "WITH f AS (SELECT l_suppkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_quantity <= 45 END AS w FROM lineitem) SELECT l_suppkey, count(*) AS checked, count_if(w) AS within_n, count_if(NOT w) AS out_n, count_if(w IS NULL) AS undecidable, CASE WHEN count_if(NOT w) > 0 THEN 'out' WHEN count_if(w IS NULL) > 0 THEN 'manual' WHEN count_if(w) > 0 THEN 'within' ELSE 'manual' END AS status FROM f GROUP BY 1")
def agg_limit_check(spark: SparkSession, root: str) -> DataFrame:
    result = F.when(F.col("l_linenumber") % 4 == 3, F.lit("待检")).otherwise(F.col("l_quantity").cast("decimal(10,2)").cast("string"))
    rows = table(spark, root, "lineitem").select("l_suppkey", result.alias("r"), F.lit("≤45").alias("m"))
    w = F.col("decision.within")
    out, unknown, ok = F.count_if(~w), F.count_if(w.isNull()), F.count_if(w)
    status = F.when(out > 0, "out").when(unknown > 0, "manual").when(ok > 0, "within").otherwise("manual")
    return limits.evaluate(rows, "r", "m").groupBy("l_suppkey").agg(F.count("*").alias("checked"), ok.alias("within_n"), out.alias("out_n"), unknown.alias("undecidable"), status.alias("status"))


@register("agg_series_summary", "SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_shipdate)::DATE::VARCHAR AS first_day, max(l_shipdate)::DATE::VARCHAR AS last_day FROM lineitem GROUP BY ALL")
def agg_series_summary(spark: SparkSession, root: str) -> DataFrame:
    day = lambda c: c.cast("date").cast("string")
    return table(spark, root, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), day(F.min("l_shipdate")).alias("first_day"), day(F.max("l_shipdate")).alias("last_day"))


@register("agg_indicator", "WITH m AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) SELECT l_returnflag, lo, hi, count_if(abs(l_extendedprice - lo) < 1e-9) AS at_low, count_if(abs(l_extendedprice - hi) < 1e-9) AS at_high FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL")
def agg_indicator(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    ends = rows.groupBy("l_returnflag").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = lambda c: F.count_if(F.abs(F.col("v") - F.col(c)) < 1e-9)
    return rows.join(ends, "l_returnflag").groupBy("l_returnflag", "lo", "hi").agg(at("lo").alias("at_low"), at("hi").alias("at_high"))


@register("stb_group_key", "SELECT l_orderkey, l_linenumber, l_returnflag || '|' || l_linestatus || CASE WHEN l_linestatus = 'F' THEN '|' || l_orderkey ELSE '' END AS group_key FROM lineitem")
def stb_group_key(spark: SparkSession, root: str) -> DataFrame:
    spec = F.when(F.col("l_linestatus") == "F", F.lit("/")).otherwise(F.col("l_linestatus"))
    blank = F.trim(spec).isin("", "/")
    key = F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.when(blank, F.concat(F.lit("|"), F.col("l_orderkey").cast("string"))).otherwise(F.lit("")))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", key.alias("group_key"))


@register("stb_risk", "WITH d AS (SELECT l_suppkey, l_returnflag, l_linenumber % 4 <> 3 AS numeric, CASE WHEN l_linenumber % 4 <> 3 THEN l_quantity <= 49 END AS w, l_linenumber % 4 <> 3 AND l_quantity <= 49 AND l_quantity >= 49 * 0.85 AS near FROM lineitem) SELECT l_suppkey, l_returnflag, CASE WHEN coalesce(bool_or(NOT w), false) THEN '高' WHEN NOT bool_or(numeric) THEN '待确认' WHEN bool_or(w IS NULL OR near) THEN '中' ELSE '低' END AS risk FROM d GROUP BY ALL")
def stb_risk(spark: SparkSession, root: str) -> DataFrame:
    """From the limit decisions on every result."""
    result = F.when(F.col("l_linenumber") % 4 == 3, F.lit("待检")).otherwise(F.col("l_quantity").cast("decimal(10,2)").cast("string"))
    rows = table(spark, root, "lineitem").select("l_suppkey", "l_returnflag", result.alias("r"), F.lit("≤49").alias("m"))
    judged = limits.evaluate(rows, "r", "m").select("l_suppkey", "l_returnflag", F.col("decision.within").alias("w"), F.col("decision.near_limit").alias("near"), (F.col("r") != "待检").alias("numeric"))
    return judged.groupBy("l_suppkey", "l_returnflag").agg(stability.risk("w", "numeric", "near").alias("risk"))


@register("vec_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select("vec_id", "embedding")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("e2")), 6).alias("score"))


_HAY = "((contains(lower(text), 'idiot')::INT + contains(lower(text), 'mail')::INT + contains(lower(text), 'tion')::INT) / 3.0)::DOUBLE"


@register("rag_keyword_score", f"SELECT doc_id, round({_HAY}, 6) AS score FROM documents WHERE {_HAY} > 0")
def rag_keyword_score(spark: SparkSession, root: str) -> DataFrame:
    scored = table(spark, root, "documents").select("doc_id", T.contained_share(["idiot", "mail", "tion"], F.col("text")).alias("s"))
    return scored.filter("s > 0").select("doc_id", F.round("s", 6).alias("score"))


@register("topk_keyword", f"SELECT doc_id, round({_HAY}, 6) AS score FROM documents WHERE {_HAY} > 0 ORDER BY {_HAY} DESC, doc_id LIMIT 20")
def topk_keyword(spark: SparkSession, root: str) -> DataFrame:
    scored = table(spark, root, "documents").select("doc_id", T.contained_share(["idiot", "mail", "tion"], F.col("text")).alias("s")).filter("s > 0")
    return scored.orderBy(F.desc("s"), "doc_id").limit(20).select("doc_id", F.round("s", 6).alias("score"))


@register("rag_lexical_blend", "SELECT doc_id, round(least(1, 0.55 * contains(lower(text), 'tion')::INT + 0.20 * contains(lower(left(text, 120)), 'tion')::INT + 0.25 * contains(source, '1')::INT), 6)::DOUBLE AS score FROM documents")
def rag_lexical_blend(spark: SparkSession, root: str) -> DataFrame:
    hit = lambda c, w: F.lower(c).contains(w).cast("int")
    score = retrieval.lexical_blend(hit(F.col("text"), "tion"), hit(F.substring("text", 1, 120), "tion"), hit(F.col("source"), "1"))
    return table(spark, root, "documents").select("doc_id", F.round(score, 6).alias("score"))


@register("rag_fuse", f"WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS v FROM embeddings, q), k AS (SELECT doc_id, {_HAY} AS k FROM documents WHERE {_HAY} > 0) SELECT coalesce(vec_id, doc_id) AS id, round(0.7 * coalesce(v, 0) + 0.3 * coalesce(k, 0), 6) AS final_score, concat_ws(',', CASE WHEN vec_id IS NOT NULL THEN 'vector' END, CASE WHEN doc_id IS NOT NULL THEN 'keyword' END) AS routes FROM v FULL JOIN k ON vec_id = doc_id")
def rag_fuse(spark: SparkSession, root: str) -> DataFrame:
    """Every hit of either search with its fused score and routes; one row, the query, is sent to all."""
    rows = table(spark, root, "embeddings")
    query = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    v = rows.crossJoin(F.broadcast(query)).select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("v"))
    k = table(spark, root, "documents").select(F.col("doc_id").alias("id"), T.contained_share(["idiot", "mail", "tion"], F.col("text")).alias("k")).filter("k > 0")
    both = v.join(k, "id", "full_outer")
    found = F.array_join(retrieval.routes(F.col("v").isNotNull(), F.col("k").isNotNull()), ",")
    score = retrieval.fuse(F.coalesce("v", F.lit(0.0)), F.coalesce("k", F.lit(0.0)), F.lit(0.0))
    return both.select("id", F.round(score, 6).alias("final_score"), found.alias("routes"))


@register("ev_role", "SELECT DISTINCT event_type, CASE WHEN regexp_matches(event_type, 'history|meta_reflection') THEN 'experience' WHEN regexp_matches(event_type, 'pharmacopeia|ich|guideline|rule|regulation') THEN 'rule' WHEN regexp_matches(event_type, 'submission|source_doc|section|raw_text|material') THEN 'fact' ELSE 'reference_info' END AS role FROM events")
def ev_role(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_type").distinct().select("event_type", retrieval.role(F.col("event_type")).alias("role"))


_EV = "round(least(CASE WHEN value <= 0 THEN 0 WHEN value <= 1 THEN value ELSE least(value / 5, 1) END + least(event_id % 4, 2) * 0.12 + least(event_id % 3, 2) * 0.08 + CASE WHEN event_id % 2 = 0 THEN 0.05 ELSE 0 END, 1.0), 3)"


@register("ev_score", f"SELECT event_id, {_EV} AS score FROM events")
def ev_score(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("event_id")
    score = retrieval.evidence_score(F.col("value"), e % 4, e % 3, F.when(e % 2 == 0, "fact").otherwise("reference_info"))
    return table(spark, root, "events").select("event_id", score.alias("score"))


@register("ev_gate", f"WITH g AS (SELECT event_id, user_id, {_EV} AS score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS dup FROM events) SELECT event_id, CASE WHEN dup THEN 'duplicate' WHEN user_id % 7 = 0 THEN 'historical_negative' WHEN score < 0.5 THEN 'low_signal' ELSE 'approved' END AS verdict FROM g")
def ev_gate(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("event_id")
    score = retrieval.evidence_score(F.col("value"), e % 4, e % 3, F.when(e % 2 == 0, "fact").otherwise("reference_info"))
    rows = table(spark, root, "events").withColumn("score", score)
    dup = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) > 1
    rows = rows.withColumn("dup", dup)
    return rows.select("event_id", retrieval.gate(F.col("dup"), F.col("user_id") % 7 == 0, F.lit(False), F.col("score")).alias("verdict"))


@register("ev_coverage", "SELECT source, CASE WHEN count_if(quality = 1) >= 3 THEN 'covered' WHEN count_if(quality = 1) > 0 THEN 'partial' ELSE 'missing' END AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def ev_coverage(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "source").join(table(spark, root, "labels"), "doc_id", "left")
    n = F.count_if(F.col("quality") == 1)
    return rows.groupBy("source").agg(F.when(n >= 3, "covered").when(n > 0, "partial").otherwise("missing").alias("coverage"))


@register("ev_experience_score", "SELECT vec_id, round(CASE label % 4 WHEN 0 THEN 300 WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE 50 END + least(vec_id % 50, 20) + CASE WHEN vec_id % 50 > 0 THEN 20 * (vec_id % 7) / (vec_id % 50) ELSE 0 END + least(vec_id / 1e6, 10), 6) AS score FROM embeddings")
def ev_experience_score(spark: SparkSession, root: str) -> DataFrame:
    uses, wins, i = F.col("vec_id") % 50, F.col("vec_id") % 7, F.col("vec_id")
    scope = F.element_at(F.array(*[F.lit(x) for x in (300, 200, 100, 50)]), F.col("label") % 4 + 1)
    score = scope + F.least(uses, F.lit(20)) + 20 * N.ratio0(wins, uses) + F.least(i / 1e6, F.lit(10.0))
    return table(spark, root, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@register("math_score_norm", "SELECT event_id, CASE WHEN value <= 0 THEN 0 WHEN value <= 1 THEN value ELSE least(value / 5, 1) END AS score FROM events")
def math_score_norm(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", N.score_norm(F.col("value")).alias("score"))


@register("dt_recency", "SELECT event_id, round(1 / (1 + (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3600e6), 9) AS recency FROM events")
def dt_recency(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = rows.agg(F.max("us").alias("now"))  # one row
    return rows.crossJoin(F.broadcast(now)).select("event_id", F.round(N.recency((F.col("now") - F.col("us")) / 1e6), 9).alias("recency"))


@register("dt_month_value", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 12.0 WHEN 1 THEN p_size / 4.0 WHEN 2 THEN p_size::DOUBLE END AS months FROM part")
def dt_month_value(spark: SparkSession, root: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(size, F.lit(" years"))).when(k == 1, F.concat(F.lit("第"), size, F.lit("周"))).when(k == 2, F.concat(size, F.lit("个月"))).otherwise("n/a")
    return table(spark, root, "part").select("p_partkey", N.month_value(said).alias("months"))


@register("st_stale", "SELECT user_id, CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 21600e6 THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY user_id")
def st_stale(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))  # one row
    return tasks.stale(last, "seen", F.col("now"), 21600).select("user_id", "status")


@register("st_lifecycle", "WITH o AS (SELECT *, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fin FROM events) SELECT user_id, CASE WHEN max((event_type = 'purchase')::INT) = 1 THEN 'completed' WHEN max((event_type = 'click')::INT) = 1 THEN 'running' ELSE 'pending' END AS state, count(*) AS effective_events FROM o WHERE fin = 0 GROUP BY user_id")
def st_lifecycle(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    return tasks.lifecycle(table(spark, root, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], kind == "click", kind == "purchase")


@register("st_attempt_latest", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def st_attempt_latest(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@register("st_log_append", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def st_log_append(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1).alias("seq"))


@register("st_prune", "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def st_prune(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))  # one row
    return last.filter("seen >= now - INTERVAL 12 HOURS").select("user_id")


@register("st_progress_sse", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def st_progress_sse(spark: SparkSession, root: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, root, "events").withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id")


@register("win_latest_task", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type IN ('click', 'view'))::INT DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def win_latest_task(spark: SparkSession, root: str) -> DataFrame:
    active = F.col("event_type").isin("click", "view").cast("int")
    return R.nth_per(table(spark, root, "events"), ["user_id"], [active.desc(), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@register("st_memory_ttl", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def st_memory_ttl(spark: SparkSession, root: str) -> DataFrame:
    return R.nth_per(table(spark, root, "conversations"), ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn")


@register("fb_severity", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'idiot|scum|moron') THEN 0.9 ELSE 0.5 END::DOUBLE AS score FROM documents")
def fb_severity(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.when(F.lower("text").rlike("idiot|scum|moron"), 0.9).otherwise(0.5).alias("score"))


_ID = "[(p_size // 10)::VARCHAR, (p_size % 10)::VARCHAR, (p_partkey % 3)::VARCHAR]"


@register("sec_common_prefix", f"WITH e AS (SELECT p_brand, p_type, min({_ID}) AS a, max({_ID}) AS b FROM part GROUP BY ALL) SELECT p_brand, p_type, array_to_string(a[1:coalesce(list_max(list_filter(range(1, 4), lambda i: a[1:i] = b[1:i])), 0)], '.') AS prefix FROM e")
def sec_common_prefix(spark: SparkSession, root: str) -> DataFrame:
    """The common prefix of the smallest and the largest id is that of all."""
    size = F.col("p_size").cast("long")
    ids = F.array(F.expr("cast(p_size div 10 as string)"), (size % 10).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    ends = table(spark, root, "part").groupBy("p_brand", "p_type").agg(F.min(ids).alias("a"), F.max(ids).alias("b"))
    shared = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
    return ends.select("p_brand", "p_type", F.array_join(F.slice("a", F.lit(1), F.coalesce(F.array_max(shared), F.lit(0))), ".").alias("prefix"))


@register("sec_sibling_group", "SELECT p_brand AS parent, count(*) AS leaves, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS children FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 2")
def sec_sibling_group(spark: SparkSession, root: str) -> DataFrame:
    out = table(spark, root, "part").groupBy(F.col("p_brand").alias("parent")).agg(F.count("*").alias("leaves"), F.sort_array(F.collect_set("p_type")).alias("c"))
    return out.filter(F.size("c") >= 2).select("parent", "leaves", F.array_join("c", ",").alias("children"))
