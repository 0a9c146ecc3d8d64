"""Queries of verdicts, rules, feedback attribution and stability, on the statuses and wordings of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import metrics, review, stability
from quillspark.operators import relational as R
from quillspark.operators.review import LACKING, NOT_APPLICABLE, PASSED, PROBLEM
from quillspark.plans.registry import register
from quillspark.sources.tables import table

_STATES = ("通过", "发现问题", "不适用", "证据不足", "执行失败", "其他", "通过")
_STATE_SQL = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"
_CHECKS_SQL = f"SELECT source AS run, lang AS module, {_STATE_SQL}[doc_id % 7 + 1] AS status, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'r' END AS reason, doc_id % 3 AS evidence, CASE WHEN doc_id % 11 = 1 THEN 'conflict' END AS kind FROM documents"
_EXPECTED_SQL = "SELECT DISTINCT source AS run, m AS module FROM documents, (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) AS m)"
_RESULTS_SQL = f"""c AS ({_CHECKS_SQL}), x AS ({_EXPECTED_SQL}),
g AS (SELECT run, module, CASE WHEN status NOT IN ('通过', '不适用', '发现问题', '证据不足', '解析异常', '执行失败') OR (status = '通过' AND evidence = 0) OR (status = '不适用' AND reason = '') THEN '证据不足' ELSE status END AS status, kind FROM c
UNION ALL SELECT run, module, '证据不足', NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.run = x.run AND c.module = x.module)),
r AS (SELECT run, module, status, CASE WHEN status NOT IN ('通过', '不适用') THEN coalesce(kind, CASE status WHEN '执行失败' THEN 'execution_error' WHEN '发现问题' THEN 'technical_issue' ELSE 'content_missing' END) END AS kind FROM g)"""


def _state(names: tuple, n):
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _results(spark: SparkSession, root: str) -> DataFrame:
    d, i = table(spark, root, "documents"), F.col("doc_id")
    checks = d.select(F.col("source").alias("run"), F.col("lang").alias("module"), _state(_STATES, i % 7).alias("status"), F.when(i % 4 == 0, "").otherwise("r").alias("reason"), (i % 3).alias("evidence"), F.when(i % 11 == 1, "conflict").alias("kind"))
    modules = F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "xx"))))
    expected = d.select(F.col("source").alias("run")).distinct().select("run", modules.alias("module"))
    return review.fold_checks(checks, expected)


@register("res_fold", f"WITH {_RESULTS_SQL} SELECT run, CASE WHEN bool_or(status = '发现问题') THEN '存在已确认问题' WHEN bool_or(kind IS NOT NULL) THEN '证据不足，尚不能支持申请' ELSE '现有证据支持继续审评' END AS support, bool_or(kind IS NOT NULL) AS need_manual_review, count_if(kind = 'file_missing') AS file_missing, count_if(kind = 'content_missing') AS content_missing, count_if(kind = 'parse_error') AS parse_error, count_if(kind = 'conflict') AS conflict FROM r GROUP BY run")
def res_fold(spark: SparkSession, root: str) -> DataFrame:
    return review.fold_run(_results(spark, root))


@register("iso_module", f"WITH {_RESULTS_SQL} SELECT run, module, status, kind, count(*) AS n FROM r GROUP BY ALL")
def iso_module(spark: SparkSession, root: str) -> DataFrame:
    """Failed modules carry their own status, those without a result lack evidence, the others go on."""
    return _results(spark, root).groupBy("run", "module", "status", "kind").agg(F.count("*").alias("n"))


@register("con_pass", f"WITH {_RESULTS_SQL} SELECT module, count(DISTINCT run) AS runs, count_if(status = '发现问题') AS conflicts FROM r GROUP BY 1")
def con_pass(spark: SparkSession, root: str) -> DataFrame:
    """What a consistency judge is given: per module, over all runs, the conflicts found."""
    return _results(spark, root).groupBy("module").agg(F.count_distinct("run").alias("runs"), F.count_if(F.col("status") == PROBLEM).alias("conflicts"))


_QA = [
    ("quality IS NULL", "missing_verdict"), ("toxic = 1 AND quality = 0", "incomplete_negative"), ("toxic = 1 AND quality = 1", "contradictory"), ("n_chars < 100", "reasoning_gap"),
]


@register("qa_section", "SELECT doc_id, issue FROM (SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in _QA) + "], lambda x: x IS NOT NULL)) AS issue FROM documents LEFT JOIN labels USING (doc_id))")
def qa_section(spark: SparkSession, root: str) -> DataFrame:
    """Issues of each section by fixed tests; a section without any passes and has no row."""
    rows = table(spark, root, "documents").select("doc_id", "n_chars").join(table(spark, root, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    found = F.array_compact(F.array(*[F.expr(f"CASE WHEN {t} THEN '{n}' END") for t, n in _QA]))
    return rows.select("doc_id", F.explode(found).alias("issue"))


@register("qa_run", "SELECT source, array_to_string(list_filter([CASE WHEN count(*) = 0 THEN 'missing_field' END, CASE WHEN count_if(toxic = 1 AND quality = 1) > 0 THEN 'open_conflicts' END, CASE WHEN count_if(quality IS NULL OR toxic = 1 OR n_chars < 100) > 0 THEN 'failed_sections' END], lambda x: x IS NOT NULL), ',') AS issues, count_if(quality IS NULL OR toxic = 1 OR n_chars < 100) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def qa_run(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "source", "n_chars").join(table(spark, root, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    failed = F.count_if(F.expr("quality IS NULL OR toxic = 1 OR n_chars < 100"))
    issues = F.array(F.when(F.count("*") == 0, "missing_field"), F.when(F.count_if(F.expr("toxic = 1 AND quality = 1")) > 0, "open_conflicts"), F.when(failed > 0, "failed_sections"))
    return rows.groupBy("source").agg(F.array_join(F.array_compact(issues), ",").alias("issues"), failed.alias("failed"))


#: Signals of a feedback record, over the rows of events.
_SIGNALS = {
    "label": "CASE event_id % 13 WHEN 0 THEN 'retrieval_miss' WHEN 1 THEN 'chunking_issue' WHEN 2 THEN 'wrong_reference' WHEN 3 THEN 'reasoning_error' WHEN 4 THEN 'style_issue' ELSE '' END",
    "rule_errors": "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END", "fact_errors": "CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END",
    "reasoning_errors": "CASE WHEN event_id % 19 = 0 THEN 2 ELSE 0 END", "evidence_errors": "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END",
    "missing_items": "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END", "hits": "user_id % 4", "queries": "user_id % 3", "focus_points": "user_id % 2", "active_rules": "user_id % 5",
    "findings": "user_id % 6", "errors": "event_id % 5", "titles": "event_id % 2",
    "error": "CASE event_id % 29 WHEN 1 THEN 'task_question_error' WHEN 2 THEN 'historical_experience_missing' WHEN 3 THEN 'unhelpful_question_to_applicant' ELSE '' END",
    "retrieval_feedback": "CASE event_type WHEN 'click' THEN 'incorrect' WHEN 'view' THEN 'partial' ELSE 'correct' END",
    "conclusion_feedback": "CASE event_type WHEN 'signup' THEN 'incorrect' WHEN 'purchase' THEN 'partial' ELSE '' END",
    "decision": "CASE event_id % 3 WHEN 0 THEN 'missed' WHEN 1 THEN 'false_positive' ELSE 'valid' END",
    "feedback_text": "CASE WHEN event_id % 5 = 0 THEN '依据不对' WHEN event_id % 5 = 1 THEN '未引用法规' ELSE '太空' END",
}
_SIGNALS_SQL = "s AS (SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _SIGNALS.items()) + f" FROM events), f AS (SELECT *, {review.sub_category('error')} AS sub_category FROM s)"


def _attributed(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("event_id", *[F.expr(e).alias(n) for n, e in _SIGNALS.items()])
    rows = rows.withColumn("sub_category", F.expr(review.sub_category("error")))
    return rows.withColumns({"root_category": F.expr(review.root_category("sub_category")), "confidence": F.expr(review.root_confidence())})


@register("fb_root_cause", f"WITH {_SIGNALS_SQL} SELECT event_id, sub_category, {review.root_category('sub_category')} AS root_category FROM f")
def fb_root_cause(spark: SparkSession, root: str) -> DataFrame:
    return _attributed(spark, root).select("event_id", "sub_category", "root_category")


@register("math_root_confidence", f"WITH {_SIGNALS_SQL} SELECT event_id, round({review.root_confidence()}, 6) AS confidence FROM f")
def math_root_confidence(spark: SparkSession, root: str) -> DataFrame:
    return _attributed(spark, root).select("event_id", F.round("confidence", 6).alias("confidence"))


_ROUTES_SQL = "CASE root_category " + " ".join(f"WHEN '{r}' THEN '{x[0]}'" for r, x in review.ROUTES.items()) + " END"
_LAYER_SQL = "CASE root_category " + " ".join(f"WHEN '{r}' THEN '{x[1]}'" for r, x in review.ROUTES.items()) + " END"


@register("fb_route", f"WITH {_SIGNALS_SQL}, g AS (SELECT event_id, decision, {review.root_category('sub_category')} AS root_category FROM f) SELECT event_id, CASE WHEN root_category = 'agent_issue' AND decision = 'valid' THEN 'regression_case' ELSE {_ROUTES_SQL} END AS routes, {_LAYER_SQL} AS target_layer FROM g")
def fb_route(spark: SparkSession, root: str) -> DataFrame:
    return review.routes(_attributed(spark, root)).select("event_id", "routes", "target_layer")


@register("fb_policy", "SELECT event_id, CASE event_type WHEN 'error' THEN 'episodic' WHEN 'purchase' THEN 'semantic' WHEN 'signup' THEN 'procedural' ELSE 'working' END AS memory_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'global' ELSE 'section' END AS scope FROM events")
def fb_policy(spark: SparkSession, root: str) -> DataFrame:
    """Memory type and scope of each kind of feedback, by a literal map."""
    kinds = F.create_map(*map(F.lit, ("error", "episodic", "purchase", "semantic", "signup", "procedural")))
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("working"))
    return table(spark, root, "events").select("event_id", kind.alias("memory_type"), F.when(F.col("event_type").isin("purchase", "signup"), "global").otherwise("section").alias("scope"))


@register("math_baseline_score", "SELECT p_partkey, round(least(0.95, 0.62 + CASE WHEN p_size % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN p_size % 3 > 0 THEN 0.06 ELSE 0 END + CASE WHEN p_size % 5 > 0 THEN 0.08 ELSE 0 END)::DOUBLE, 6) AS score FROM part")
def math_baseline_score(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("p_size")
    score = F.lit(0.62) + F.when(n % 2 == 0, 0.08).otherwise(0.0) + F.when(n % 3 > 0, 0.06).otherwise(0.0) + F.when(n % 5 > 0, 0.08).otherwise(0.0)
    return table(spark, root, "part").select("p_partkey", F.round(F.least(F.lit(0.95), score), 6).alias("score"))


@register("agg_review_total", "WITH c AS (SELECT len(list_intersect(a.k, b.k)) AS tp, len(a.k) AS na, len(b.k) AS nb FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS k FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, list_distinct(string_split(text, ' ')) AS k FROM documents) b USING (doc_id)) SELECT count(*) AS cases, round(sum(tp) / sum(nb), 6) AS micro_precision, round(sum(tp) / sum(na), 6) AS micro_recall, round(avg(tp / nb), 6) AS macro_precision, round(avg(tp / na), 6) AS macro_recall FROM c")
def agg_review_total(spark: SparkSession, root: str) -> DataFrame:
    """Micro figures from summed counts and macro figures as means over cases."""
    own = table(spark, root, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("a"))
    both = own.join(own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    s = metrics.set_scores(F.col("a"), F.col("b"))
    cases = both.select(*[s[k].alias(k) for k in ("tp", "fp", "fn", "precision", "recall")])
    total = lambda *names: sum((F.sum(n) for n in names), F.lit(0))
    return cases.agg(F.count("*").alias("cases"), F.round(F.sum("tp") / total("tp", "fp"), 6).alias("micro_precision"), F.round(F.sum("tp") / total("tp", "fn"), 6).alias("micro_recall"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"))


_CRITERIA = ["项目=R；适用条件=F；下降≥10%；依据=任一时间点", "项目=A；适用条件=F；绝对变化>15%；依据=末点", "项目=N；适用条件=O；上升≥5%；依据=各时间点", "项目=N；适用条件=F；变化较大"]


@register("stb_significant", """WITH p AS (SELECT l_orderkey AS k, l_returnflag AS i, l_linestatus AS c, (l_linenumber - 1) // 2 AS m, l_quantity::DOUBLE AS v FROM lineitem),
b AS (SELECT k, i, c, count(DISTINCT CASE WHEN m = 0 THEN v END) AS n, max(CASE WHEN m = 0 THEN v END) AS base FROM p GROUP BY ALL)
SELECT k, i AS indicator, c AS condition, m AS month, v AS value, CASE WHEN n <> 1 THEN '证据不足' WHEN (i = 'R' AND base - v >= 10) OR (i = 'A' AND abs(v - base) > 15) OR (i = 'N' AND v - base >= 5) THEN '发现问题' ELSE '通过' END AS status
FROM p JOIN b USING (k, i, c) WHERE m > 0 AND ((i = 'R' AND c = 'F') OR (i = 'A' AND c = 'F') OR (i = 'N' AND c = 'O'))""")
def stb_significant(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("indicator"), F.col("l_linestatus").alias("condition"), F.expr("(l_linenumber - 1) div 2").alias("month"), F.col("l_quantity").cast("double").alias("value"))
    criteria = spark.createDataFrame([(t,) for t in _CRITERIA], "text string")
    return stability.significant(rows, criteria, ["k"]).select("k", "indicator", "condition", "month", "value", "status")


@register("stb_enrich", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_linenumber * 12.0 WHEN 1 THEN l_linenumber / 4.0 ELSE l_linenumber END::DOUBLE AS month,
CASE WHEN l_suppkey % 10 <> 3 AND l_linenumber % 5 = 0 THEN l_quantity::DOUBLE END AS value,
CASE WHEN l_suppkey % 10 = 3 THEN 'numeric_uncertain' ELSE ['exact', 'not_detected', 'boundary', 'composite', 'qualitative'][l_linenumber % 5 + 1] END AS kind FROM lineitem""")
def stb_enrich(spark: SparkSession, root: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("decimal(10,2)").cast("string")
    time = F.concat(n.cast("string"), _state(("年", "周", "个月"), n % 3))
    result = F.element_at(F.array(F.concat(q, F.lit("%")), F.lit("未检出"), F.concat(F.lit("≤"), q), F.concat(F.lit("a:"), q, F.lit(";b:1")), F.lit("白色粉末")), (n % 5 + 1).cast("int"))
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", time.alias("time"), result.alias("result"))
    return stability.enrich(rows, "time", "result", F.col("l_suppkey") % 10 == 3).select("l_orderkey", "l_linenumber", "month", "value", "kind")


@register("stb_group_unit", "WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS i, ['%', 'mg/g', ''][(l_suppkey + l_linenumber) % 3 + 1] AS unit FROM lineitem), g AS (SELECT l_suppkey, i, count(DISTINCT unit) > 1 AS s FROM u GROUP BY ALL) SELECT l_orderkey, l_linenumber, CASE WHEN s THEN i || ' [' || CASE WHEN unit = '' THEN '单位未知' ELSE unit END || ']' ELSE i END AS series FROM u JOIN g USING (l_suppkey, i)")
def stb_group_unit(spark: SparkSession, root: str) -> DataFrame:
    unit = _state(("%", "mg/g", ""), (F.col("l_suppkey") + F.col("l_linenumber")) % 3)
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("indicator"), unit.alias("unit"))
    return stability.split_by_unit(rows, ["l_suppkey"], "indicator", "unit").select("l_orderkey", "l_linenumber", "series")


@register("stb_conclusion", """SELECT c_custkey, CASE WHEN n = 0 THEN '需补充资料' WHEN bad > 0 THEN '不支持延长' WHEN open > 0 AND top >= 24 THEN '需人工确认' WHEN gaps > 0 THEN '需补充资料' WHEN c_nationkey % 3 = 0 OR c_nationkey % 4 = 1 OR n % 5 = 2 THEN '需人工确认' ELSE '支持延长' END AS result
FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n, count_if(o_totalprice > 490000) AS bad, count_if(o_orderstatus = 'P') AS open, coalesce(max(month(o_orderdate) * 3), 0) AS top, count_if(o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 7 = 0) AS gaps FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def stb_conclusion(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    gap = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderkey") % 7 == 0)
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 490000).alias("bad"), F.count_if(F.col("o_orderstatus") == "P").alias("open"), F.max(F.month("o_orderdate") * 3).alias("top"), F.count_if(gap).alias("gaps"))
    rows = table(spark, root, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n", "bad", "open", "top", "gaps"])
    k = F.col("c_nationkey")
    significance = F.when(k % 4 == 1, LACKING).otherwise(PASSED)
    result = stability.conclusion(F.col("n"), F.col("bad"), F.col("top") < 24, F.col("open"), F.col("gaps"), k % 3 != 0, significance, (F.col("n") % 5 == 2).cast("int"))
    return rows.select("c_custkey", result.alias("result"))


@register("rul_scope", "SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN '规则任务类型不属于本次延长有效期审评' WHEN p_size % 7 = 3 THEN '申请表明确选择其他变更事项' WHEN p_size % 11 = 5 THEN '药品类别与规则适用类别不一致' WHEN p_size % 13 = 2 THEN '规则变更事项范围不包含本次申请' ELSE '' END AS outside FROM part")
def rul_scope(spark: SparkSession, root: str) -> DataFrame:
    """Why a rule is out of scope, by task, matter, category and item; blank if it applies."""
    n = F.col("p_size")
    steps = [(n % 5 == 4, "规则任务类型不属于本次延长有效期审评"), (n % 7 == 3, "申请表明确选择其他变更事项"), (n % 11 == 5, "药品类别与规则适用类别不一致"), (n % 13 == 2, "规则变更事项范围不包含本次申请")]
    out = F.lit("")
    for test, why in reversed(steps):
        out = F.when(test, why).otherwise(out)
    return table(spark, root, "part").select("p_partkey", out.alias("outside"))


_CODES = ("TVS-FR-001", "TVS-STAB-001", "TVS-XX-999")
_VALID = [("code = 'TVS-XX-999'", "当前执行器不支持该规则标识"), ("extra = 1", "条件包含不支持的参数"), ("code = 'TVS-STAB-001' AND (least_n IS NULL OR least_n < 1 OR least_n > 100)", "minimum_batches 必须是1至100的整数")]
_RULES_SQL = "SELECT p_partkey, ['TVS-FR-001', 'TVS-STAB-001', 'TVS-XX-999'][p_partkey % 3 + 1] AS code, CASE WHEN p_size % 9 = 0 THEN 1 ELSE 0 END AS extra, TRY_CAST(CASE WHEN p_size % 6 = 0 THEN 'x' ELSE (p_size * 4 - 20)::VARCHAR END AS INT) AS least_n FROM part"


def _rules(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("p_size")
    least = F.when(n % 6 == 0, "x").otherwise((n * 4 - 20).cast("string")).try_cast("int")
    return table(spark, root, "part").select("p_partkey", _state(_CODES, F.col("p_partkey") % 3).alias("code"), F.when(n % 9 == 0, 1).otherwise(0).alias("extra"), least.alias("least_n"))


@register("rul_validate", f"SELECT p_partkey, {review.decide(_VALID, '')} AS message FROM ({_RULES_SQL})")
def rul_validate(spark: SparkSession, root: str) -> DataFrame:
    return _rules(spark, root).select("p_partkey", F.expr(review.decide(_VALID, "")).alias("message"))


@register("rul_isolate", f"SELECT p_partkey, CASE WHEN message = '' THEN 'completed' ELSE 'failed' END AS execution_status, CASE WHEN message = '' THEN least_n END AS least_n, CASE WHEN message <> '' THEN '执行失败：' || message END AS error FROM (SELECT *, {review.decide(_VALID, '')} AS message FROM ({_RULES_SQL}))")
def rul_isolate(spark: SparkSession, root: str) -> DataFrame:
    """A rule that can't run has a status and an error of its own; the others complete."""
    rows = _rules(spark, root).withColumn("message", F.expr(review.decide(_VALID, "")))
    fine = F.col("message") == ""
    return rows.select("p_partkey", F.when(fine, "completed").otherwise("failed").alias("execution_status"), F.when(fine, F.col("least_n")).alias("least_n"), F.when(~fine, F.concat(F.lit("执行失败："), "message")).alias("error"))


#: Counts about a subject that the nineteen rules look at, over the rows of customer.
_FACTS = {
    "files_missing": "c_custkey % 3", "content_missing": "c_custkey % 5 - 3", "unparsed": "CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END", "applicant": "c_custkey % 4", "holder": "c_custkey % 7",
    "conflicts": "c_custkey % 11 - 8", "unverified": "c_custkey % 13 - 10", "fields_missing": "c_custkey % 6 - 4", "selected": "c_nationkey % 2", "specs": "c_nationkey % 3", "packs": "c_nationkey % 4",
    "plan_known": "c_nationkey % 2", "gaps": "c_custkey % 9 - 6", "prescription": "c_custkey % 5", "packaging_study": "c_nationkey % 3", "scale": "c_custkey % 4", "batches": "c_nationkey % 5", "storage": "c_custkey % 6",
    "bridge_bad": "c_custkey % 23 - 21", "versions": "c_nationkey % 3", "bridged": "c_custkey % 2", "records": "c_custkey % 8", "out_of_limit": "c_custkey % 19 - 16", "undecided": "c_custkey % 10 - 7", "significant": "c_custkey % 7 - 5", "criteria": "c_nationkey % 2", "label_docs": "c_custkey % 3", "label_bad": "c_custkey % 5 - 3",
    "registration": "c_custkey % 4", "compatibility": "c_nationkey % 4", "promise": "c_custkey % 3",
}
#: The rules: each an ordered list that ends in passed.
RULES = {
    "TVS-FR-001": [("files_missing > 1", PROBLEM), ("unparsed > 0", LACKING), ("content_missing > 0", PROBLEM)],
    "TVS-FR-002": [("applicant = 0 OR holder = 0", LACKING), ("applicant <> holder % 4", PROBLEM)],
    "TVS-CONS-001": [("conflicts > 0", PROBLEM), ("unverified > 0", LACKING)],
    "TVS-FORM-001": [("fields_missing > 0 AND selected > 0", PROBLEM), ("fields_missing > 0", LACKING)],
    "TVS-FORM-002": [("specs = 0 OR packs = 0", LACKING), ("specs = 1 AND packs = 1", NOT_APPLICABLE), ("plan_known = 0", LACKING), ("gaps > 0", PROBLEM)],
    "TVS-TECH-001": [("prescription = 0", LACKING), ("prescription = 1", PROBLEM)],
    "TVS-TECH-002": [("packs = 0 OR packaging_study = 0", LACKING), ("packs <> packaging_study", PROBLEM)],
    "TVS-TECH-003": [("scale = 0", LACKING), ("scale = 1", PROBLEM)],
    "TVS-STAB-001": [("batches > 0 AND batches < 3", PROBLEM), ("batches = 0", LACKING)],
    "TVS-STAB-002": [("storage = 0", LACKING), ("storage = 1", PROBLEM)],
    "TVS-STAB-003": [("gaps > 0", PROBLEM), ("plan_known = 0", LACKING)],
    "TVS-QLT-001": [("bridge_bad > 0", PROBLEM), ("versions = 0 OR (versions > 1 AND bridged = 0)", LACKING)],
    "TVS-QLT-002": [("out_of_limit > 0", PROBLEM), ("undecided > 0 OR records = 0", LACKING)],
    "TVS-STAB-004": [("significant > 0", PROBLEM), ("criteria = 0", LACKING)],
    "TVS-TECH-004": [("gaps > 0", PROBLEM), ("plan_known = 0 OR out_of_limit > 0", LACKING)],
    "TVS-TECH-005": [("conflicts > 1", PROBLEM), ("storage = 0", LACKING)],
    "TVS-TECH-006": [("label_docs = 0", LACKING), ("label_bad > 0", PROBLEM)],
    "TVS-RISK-001": [("registration = 0", LACKING), ("compatibility = 3", NOT_APPLICABLE), ("compatibility = 0", PROBLEM)],
    "TVS-POST-001": [("promise = 0", LACKING), ("promise = 1", PROBLEM)],
}
_FACTS_SQL = "SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in _FACTS.items()) + " FROM customer"
_EVALUATED_SQL = f"SELECT c_custkey, unnest([{', '.join(repr(c) for c in RULES)}]) AS code, unnest([{', '.join(review.decide(steps, PASSED) for steps in RULES.values())}]) AS status FROM ({_FACTS_SQL})"


def _evaluated(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in _FACTS.items()])
    verdicts = F.array(*[F.struct(F.lit(code).alias("code"), F.expr(review.decide(steps, PASSED)).alias("status")) for code, steps in RULES.items()])
    return rows.select("c_custkey", F.explode(verdicts).alias("v")).select("c_custkey", "v.code", "v.status")


@register("rul_evaluate_19", _EVALUATED_SQL)
def rul_evaluate_19(spark: SparkSession, root: str) -> DataFrame:
    """All nineteen rules in one pass over the subjects."""
    return _evaluated(spark, root)


_FIELDS = ("reference_standard", "potency_correction", "characteristic_max_wavelengths", "absorbance_ratio", "uv_method_present")
_CHECKS_P52 = [
    ("missing_any", _FIELDS[:2], 1), ("missing_all", _FIELDS[3:], 1), ("missing_k_of_n", _FIELDS, 3), ("assay_correction_logic", (), 1), ("uv_specificity_signal_missing", (), 1), ("single_uv_without_support", (), 1),
]
_FOUND_SQL = "list_filter([" + ", ".join(f"CASE WHEN p_partkey % {k} = 0 THEN '{f}' END" for k, f in zip((2, 3, 2, 5, 7), _FIELDS, strict=True)) + "], lambda x: x IS NOT NULL)"


@register("rul_checks_p52", f"""SELECT p_partkey, NOT (h(r) AND h(p)) AS missing_any, NOT (h(a) OR h(u)) AS missing_all, len(f) < 3 AS missing_k_of_n, h(r) AND NOT h(p) AS assay_correction_logic, h(m) AND NOT h(a) AS uv_specificity_signal_missing, h(u) OR h(m) AS single_uv_without_support FROM (SELECT p_partkey, {_FOUND_SQL} AS f FROM part)""".replace("h(r)", "list_contains(f, 'reference_standard')").replace("h(p)", "list_contains(f, 'potency_correction')").replace("h(a)", "list_contains(f, 'absorbance_ratio')").replace("h(u)", "list_contains(f, 'uv_method_present')").replace("h(m)", "list_contains(f, 'characteristic_max_wavelengths')"))
def rul_checks_p52(spark: SparkSession, root: str) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col("p_partkey") % k == 0, f) for k, f in zip((2, 3, 2, 5, 7), _FIELDS, strict=True)]))
    rows = table(spark, root, "part").select("p_partkey", found.alias("f"))
    return rows.select("p_partkey", *[review.triggered(name, list(fields), F.col("f"), least).alias(name) for name, fields, least in _CHECKS_P52])


# Method profiles by keyword; assays are told apart first.
_PROFILES = [("contains(t, 'token') AND contains(t, 'mail')", "assay_titration"), ("contains(t, 'token')", "assay_hplc"), ("contains(t, 'licen')", "identification"), ("contains(t, 'tion')", "related_substances"), ("contains(t, 'the ')", "water_content")]


@register("rul_profiles", f"SELECT doc_id, {review.decide(_PROFILES, '')} AS profile FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def rul_profiles(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.lower("text").alias("t")).select("doc_id", F.expr(review.decide(_PROFILES, "")).alias("profile"))


_ALIASES = {"contact": ("mail", "phone"), "secret": ("token",), "licence": ("licen",)}


@register("rul_entities", "SELECT doc_id, field, excerpt FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, CASE " + " ".join(f"WHEN contains(lower(text), '{a}') THEN substr(text, greatest(instr(lower(text), '{a}') - 20, 1), 40)" for a in names) + " END AS excerpt FROM documents" for f, names in _ALIASES.items()) + ") WHERE excerpt IS NOT NULL")
def rul_entities(spark: SparkSession, root: str) -> DataFrame:
    """Fields found by any of their aliases, the first alias that occurs giving the excerpt."""
    low, text = F.lower("text"), F.col("text")
    entries = []
    for field, names in _ALIASES.items():
        found = F.lit(None).cast("string")
        for a in reversed(names):
            at = F.instr(low, a)
            found = F.when(at > 0, text.substr(F.greatest(at - 20, F.lit(1)), F.lit(40))).otherwise(found)
        entries.append(F.struct(F.lit(field).alias("field"), found.alias("excerpt")))
    rows = table(spark, root, "documents").select("doc_id", F.explode(F.array(*entries)).alias("e")).select("doc_id", "e.field", "e.excerpt")
    return rows.filter("excerpt IS NOT NULL")


_SCOPES = ("all", "src1", "", "src2.en", "src")


@register("rul_resolve", "WITH r AS (SELECT n_nationkey AS rule_id, n_regionkey AS priority, ['all', 'src1', '', 'src2.en', 'src'][n_nationkey % 5 + 1] AS scope, CASE WHEN n_nationkey % 3 = 0 THEN 'all' WHEN n_nationkey % 3 = 1 THEN 'review' ELSE 'other' END AS task FROM nation), s AS (SELECT DISTINCT source || '.' || lang AS section FROM documents) SELECT section, rule_id, row_number() OVER (PARTITION BY section ORDER BY priority, rule_id) AS pos FROM r, s WHERE task IN ('all', 'review') AND (scope IN ('', 'all') OR section = scope OR starts_with(section, scope || '.'))")
def rul_resolve(spark: SparkSession, root: str) -> DataFrame:
    """Active rules of the task in scope of each section, in order of priority."""
    scope = _state(_SCOPES, F.col("n_nationkey") % 5)
    rules = table(spark, root, "nation").filter(F.col("n_nationkey") % 3 != 2).select(F.col("n_nationkey").alias("rule_id"), F.col("n_regionkey").alias("priority"), F.when(scope == "", "all").otherwise(scope).alias("scope"))
    sections = table(spark, root, "documents").select(F.concat_ws(".", "source", "lang").alias("section")).distinct()
    found = R.scope_join(sections, rules, "section", "scope")
    return found.select("section", "rule_id", F.row_number().over(Window.partitionBy("section").orderBy("priority", "rule_id")).cast("long").alias("pos"))


@register("rul_overlay", "WITH r AS (SELECT p_partkey AS rule_id, p_type AS hints FROM part WHERE p_size % 4 <> 0), a AS (SELECT s_suppkey AS rule_id, 'hint' || s_nationkey AS hint FROM supplier) SELECT coalesce(r.rule_id, a.rule_id) AS rule_id, concat_ws('|', r.hints, a.hint) AS hints, r.rule_id IS NULL AS synthetic FROM r FULL JOIN a ON r.rule_id = a.rule_id WHERE coalesce(r.rule_id, 0) % 10 <> 7 OR r.rule_id IS NULL", )
def rul_overlay(spark: SparkSession, root: str) -> DataFrame:
    """Excluded rules go, hints are appended once, included rules that aren't there come in as synthetic rows."""
    rules = table(spark, root, "part").filter("p_size % 4 != 0").select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("hints"))
    added = table(spark, root, "supplier").select(F.col("s_suppkey").alias("rule_id"), F.concat(F.lit("hint"), F.col("s_nationkey").cast("string")).alias("hint"))
    joined = rules.withColumn("own", F.lit(True)).join(added, "rule_id", "full_outer").filter("own IS NULL OR rule_id % 10 != 7")
    hints = F.array_join(F.array_distinct(F.array_compact(F.array("hints", "hint"))), "|")
    return joined.select("rule_id", hints.alias("hints"), F.col("own").isNull().alias("synthetic"))
