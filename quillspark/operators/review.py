"""Statuses of checks folded into modules, rules and runs; named checks on fields; feedback attribution.

Decision lists are ordered pairs (condition, outcome) in plain SQL, so the first that holds decides, and the same list serves
Catalyst and any other engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of a check.
PASSED, NOT_APPLICABLE, PROBLEM, LACKING, UNPARSED, FAILED = "通过", "不适用", "发现问题", "证据不足", "解析异常", "执行失败"
STATUSES = (PASSED, NOT_APPLICABLE, PROBLEM, LACKING, UNPARSED, FAILED)
# What is asked for by kind of issue.
ACTIONS = {
    "parse_error": "核对原件或重试解析，必要时人工核查",
    "execution_error": "重试该检查并人工核查，不能认定申请人未提交",
    "file_missing": "补充所列类别材料",
    "conflict": "核对双方材料及具体值，说明差异或更正对应内容",
    "technical_issue": "核对具体技术问题并补充相应处理说明或论证",
    "content_missing": "核对所列材料并补充对应字段、数据或论证",
}
# Outcomes of a run.
SUPPORT = ("存在已确认问题", "证据不足，尚不能支持申请", "现有证据支持继续审评")


def decide(steps: list[tuple[str, str]], otherwise: str) -> str:
    """A decision list as SQL text."""
    return "CASE " + " ".join(f"WHEN {test} THEN {_quoted(outcome)}" for test, outcome in steps) + f" ELSE {_quoted(otherwise)} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold_status(status: str) -> Column:
    """The status of a rule from its checks: a problem, else lacking evidence, else not applicable if all are, else passed."""
    s = F.col(status)
    has = lambda value: F.coalesce(F.bool_or(s == value), F.lit(False))
    return F.when(has(PROBLEM), PROBLEM).when(has(LACKING), LACKING).when(F.bool_and(s == NOT_APPLICABLE), NOT_APPLICABLE).otherwise(PASSED)


def fold_checks(checks: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks (run, module, status, reason, evidence, kind) as results, with expected modules (run, module) that have none.

    Unknown statuses, passes without evidence and inapplicability without a reason lack evidence; what is neither passed
    nor inapplicable is an issue of a kind, with the action it needs.
    """
    s, reason = F.col("status"), F.coalesce("reason", F.lit(""))
    known = F.coalesce(s.isin(*STATUSES), F.lit(False))
    weak = ~known | ((s == PASSED) & (F.coalesce("evidence", F.lit(0)) == 0)) | ((s == NOT_APPLICABLE) & (reason == ""))
    given = checks.withColumn("status", F.when(weak, LACKING).otherwise(s))
    absent = expected.join(checks.select("run", "module").distinct(), ["run", "module"], "left_anti")
    absent = absent.select("run", "module", F.lit(LACKING).alias("status"), F.lit("所需规则未执行或结果未记录").alias("reason"), F.lit(0).cast("long").alias("evidence"), F.lit(None).cast("string").alias("kind"))
    both = given.select(*absent.columns).unionByName(absent)
    issue = ~F.col("status").isin(PASSED, NOT_APPLICABLE)
    default = F.when(F.col("status") == FAILED, "execution_error").when(F.col("status") == PROBLEM, "technical_issue").otherwise("content_missing")
    both = both.withColumn("kind", F.when(issue, F.coalesce("kind", default)))
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return both.withColumn("action", F.when(issue, F.try_element_at(actions, F.col("kind"))))


def fold_run(results: DataFrame) -> DataFrame:
    """One row a run: its support, whether it needs a person, issues by kind."""
    issue = F.col("kind").isNotNull()
    problem = F.bool_or(F.col("status") == PROBLEM)
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("file_missing", "content_missing", "parse_error", "conflict")]
    return results.groupBy("run").agg(F.when(problem, SUPPORT[0]).when(F.bool_or(issue), SUPPORT[1]).otherwise(SUPPORT[2]).alias("support"), F.bool_or(issue).alias("need_manual_review"), *kinds)


# Sub-categories in the order in which recorded errors are looked through, by root.
ROOTS = {
    "rag_issue": ("query_miss", "retrieval_scope_error", "retrieval_ranking_error", "historical_experience_missing"),
    "agent_issue": (
        "knowledge_understanding_error", "section_fact_extraction_error", "focus_point_miss", "task_question_error", "reasoning_chain_error",
        "evidence_interpretation_error", "over_inference", "under_identification", "wrong_severity",
    ),
    "prompt_issue": ("wording_not_actionable", "unhelpful_question_to_applicant"),
    "rule_issue": ("rule_mapping_error", "missing_regulatory_basis"),
}


def sub_category(error: str | None = None) -> str:
    """The sub-category of a feedback record as SQL over its signals.

    Signals: label, rule_errors, fact_errors, reasoning_errors, evidence_errors, missing_items, hits, queries, focus_points,
    active_rules, findings, retrieval_feedback, conclusion_feedback, decision, feedback_text; ``error`` names a column that
    holds the first recorded error, if any. Explicit labels come first, then counted errors, retrieval, conclusions and
    the decision.
    """
    says = lambda *words: "(" + " OR ".join(f"contains(feedback_text, '{w}')" for w in words) + ")"
    blind = "(hits <= 0 OR queries <= 0)"
    steps = [("label = 'retrieval_miss'", "query_miss"), ("label = 'chunking_issue'", "retrieval_scope_error"), ("label = 'wrong_reference'", "missing_regulatory_basis"), ("label = 'reasoning_error'", "evidence_interpretation_error"), ("label = 'style_issue'", "wording_not_actionable")]
    steps += [(f"rule_errors > 0 AND (active_rules <= 0 OR {says('法规', '药典')})", "missing_regulatory_basis"), ("rule_errors > 0", "rule_mapping_error"), ("fact_errors > 0", "section_fact_extraction_error"), ("reasoning_errors > 0", "reasoning_chain_error")]
    steps += [("evidence_errors > 0 AND hits <= 0", "query_miss"), ("evidence_errors > 0 AND retrieval_feedback = 'incorrect'", "retrieval_scope_error"), ("evidence_errors > 0", "evidence_interpretation_error")]
    steps += [(f"missing_items > 0 AND {blind}", "query_miss"), ("missing_items > 0 AND retrieval_feedback = 'incorrect'", "retrieval_scope_error"), ("missing_items > 0 AND focus_points > 0", "focus_point_miss"), ("missing_items > 0", "under_identification")]
    if error is not None:
        steps += [(f"{error} = '{x}'", x) for names in ROOTS.values() for x in names]
    steps += [(f"retrieval_feedback = 'incorrect' AND {blind}", "query_miss"), ("retrieval_feedback = 'incorrect'", "retrieval_ranking_error"), ("retrieval_feedback = 'partial'", "retrieval_scope_error")]
    steps += [("conclusion_feedback = 'incorrect' AND findings > 0 AND hits > 0", "evidence_interpretation_error"), ("conclusion_feedback = 'incorrect'", "over_inference"), ("conclusion_feedback = 'partial'", "under_identification")]
    missed, wrong = "decision IN ('missed', 'missing_risk')", "decision IN ('false_positive', 'rejected')"
    steps += [(f"{missed} AND {blind}", "query_miss"), (f"{missed} AND focus_points > 0", "focus_point_miss"), (missed, "under_identification")]
    steps += [(f"{wrong} AND hits > 0 AND findings > 0", "evidence_interpretation_error"), (f"{wrong} AND findings > 0", "over_inference"), (wrong, "wrong_severity")]
    steps += [(f"{says('依据')} AND {says('不匹配', '不对', '错误')}", "missing_regulatory_basis"), (says("不可执行", "太空", "进一步说明"), "wording_not_actionable"), ("hits <= 0", "query_miss")]
    return decide(steps, "")


def root_category(sub: str) -> str:
    """The root of a sub-category, as SQL over its column."""
    steps = [(f"{sub} IN ({', '.join(map(_quoted, names))})", root) for root, names in ROOTS.items()]
    return decide(steps, "general_issue")


def root_confidence() -> str:
    """How sure the attribution is, as SQL over what was there to go by."""
    parts = [("label <> ''", 0.2), ("sub_category <> ''", 0.15), ("queries > 0", 0.1), ("errors > 0", 0.1), ("titles > 0", 0.05)]
    return "CAST(least(0.95, 0.4 + " + " + ".join(f"CASE WHEN {test} THEN {x} ELSE 0 END" for test, x in parts) + ") AS DOUBLE)"


# Of each root the routes, the layer and the patch scope.
ROUTES = {
    "rag_issue": ("retrieval_fix,rerank_dataset,regression_case", "retrieval", "section_retrieval"),
    "rule_issue": ("rule_fix,prompt_fix,regression_case", "rule", "section_rule_mapping"),
    "prompt_issue": ("prompt_fix,preference_dataset,regression_case", "wording", "review_output_style"),
    "agent_issue": ("workflow_fix,prompt_fix,preference_dataset,regression_case", "reasoning", "section_reasoning"),
    "workflow_issue": ("workflow_fix,regression_case", "workflow", "workflow_policy"),
    "general_issue": ("regression_case", "general", "section_general"),
}


def routes(feedback: DataFrame) -> DataFrame:
    """Routes, layer and scope of attributed feedback (root_category, decision): a small mapping table sent to all."""
    rows = [(root, *x) for root, x in ROUTES.items()]
    table = feedback.sparkSession.createDataFrame(rows, "root_category string, routes string, target_layer string, patch_scope string")
    joined = feedback.join(F.broadcast(table), "root_category", "left")
    settled = (F.col("root_category") == "agent_issue") & (F.col("decision") == "valid")
    return joined.withColumn("routes", F.when(settled, "regression_case").otherwise(F.coalesce("routes", F.lit("regression_case"))))


def triggered(check: str, fields: list[str], found: Column, least: int = 1) -> Column:
    """Whether a named check on the fields that were found (an array) fires."""
    has = lambda f: F.array_contains(found, f)
    present = sum((has(f).cast("int") for f in fields), F.lit(0))
    if check in ("missing_field", "missing_any"):
        return present < len(fields)
    if check == "missing_all":
        return present == 0 if fields else F.lit(False)
    if check == "missing_k_of_n":
        return present < max(1, min(least, len(fields))) if fields else F.lit(False)
    if check == "assay_correction_logic":
        return (has("reference_standard") | has("reference_preparation")) & ~(has("potency_correction") | has("purity_correction"))
    if check == "uv_specificity_signal_missing":
        return has("characteristic_max_wavelengths") & ~(has("characteristic_min_wavelengths") | has("absorbance_ratio") | has("specificity_support"))
    if check == "single_uv_without_support":
        return (has("uv_method_present") | has("characteristic_max_wavelengths")) & ~(has("complementary_identification_method") | has("specificity_support"))
    return F.lit(False)


def bridge(versions: str, refuted: str, pending: str, editorial: str, method: str, bridged: str) -> Column:
    """Whether results under several versions of a standard compare: refuted, pending, one version, editorial changes, a bridged method, or open."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    several = F.coalesce(F.col(versions), F.lit(0)) > 1
    return (
        F.when(yes(refuted), PROBLEM).when(yes(pending), LACKING).when(F.col(versions) == 1, PASSED)
        .when(several & yes(editorial), PASSED).when(several & yes(method) & yes(bridged), PASSED).otherwise(LACKING)
    )
