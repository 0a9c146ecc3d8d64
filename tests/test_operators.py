"""Operators against brute force on small random tables, with nulls, blanks, ties and empty inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import plug
from quillspark.operators import chunks, forms, review, stability, traces, trees
from quillspark.operators import relational as R


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names or df.columns) for r in df.collect())


def test_global_rank(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1, 2, 3]), rng.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "i int, a int, b int").repartition(7)
    got = {r["i"]: r["n"] for r in R.global_rank(df, F.col("a"), [F.col("b"), F.col("i")], "n").collect()}
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, 1)}
    down = {r["i"]: r["n"] for r in R.global_rank(df, F.col("a"), [F.col("i")], "n", falling=True).collect()}
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert down == {r[0]: n for n, r in enumerate(order, 1)}
    assert R.global_rank(df.limit(0), F.col("a"), [F.col("i")], "n").count() == 0


def test_overlap_join_in_stretches(spark):
    rng = random.Random(2)
    spans = [(rng.randint(0, 2), i, s := rng.randint(-50, 50), s + rng.randint(-2, 40)) for i in range(80)]
    a = spark.createDataFrame(spans, "k int, i int, start int, stop int")
    b = a.select("k", F.col("i").alias("j"), F.col("start").alias("begin"), F.col("stop").alias("finish"))
    want = Counter((x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in spans for y in spans if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    for width in (None, 7, 1000):
        assert rows_of(R.overlap_join(a, b, ["k"], width), "k", "i", "j", "shared") == want


def test_box_join(spark):
    rng = random.Random(3)
    box = lambda size: (x := rng.uniform(-30, 30), x + rng.uniform(0, size), y := rng.uniform(-30, 30), y + rng.uniform(0, size))
    outer, inner = [(i, *box(25)) for i in range(60)], [(i, *box(6)) for i in range(60)]
    a = spark.createDataFrame(outer, "o int, x0 double, x1 double, y0 double, y1 double").withColumn("k", F.lit(1))
    b = spark.createDataFrame(inner, "i int, u0 double, u1 double, v0 double, v1 double").withColumn("k", F.lit(1))
    want = Counter((p[0], q[0]) for p in outer for q in inner if p[1] <= q[1] and p[2] >= q[2] and p[3] <= q[3] and p[4] >= q[4])
    assert want and rows_of(R.box_join(a, b, ["k"], 5.0, 9.0), "o", "i") == want


def test_containment_join(spark):
    rng = random.Random(4)
    words = lambda n, most: sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, most))) for _ in range(n)})
    left, right = words(60, 7), words(60, 7)
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    want = {(x, y) for x in left for y in right if x and y and (x in y or y in x)}
    got = rows_of(R.containment_join(a, b, "l", "r", opening=3))
    assert set(got) == want and set(got.values()) == {1}


def test_asof_join(spark):
    rng = random.Random(5)
    left = [(i, rng.randint(0, 3), rng.randint(0, 300)) for i in range(100)]
    right = [(rng.randint(0, 2), rng.randint(0, 300), rng.randint(0, 10**6)) for _ in range(150)]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    want = {}
    for i, k, t in left:
        before = [(u, v) for q, u, v in right if q == k and u <= t]
        want[i] = max(before)[1] if before else None
    for width in (10, 10_000):
        got = R.asof_join(a, b, ["k"], "t", "v", width)
        assert {r["i"]: r["v"] for r in got.collect()} == want and got.count() == len(left)


def test_late_rows(spark):
    data = [(0, 100), (1, 50), (2, 95), (3, 200), (4, 120), (5, 189), (6, 190)]
    got = R.late_rows(spark.createDataFrame(data, "i int, t int"), F.expr("i div 2"), "t", 10)
    assert {r["i"]: r["late"] for r in got.collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_scopes_and_indexes(spark):
    items = spark.createDataFrame([("a.b.c",), ("a",), ("ab",)], "section string")
    rules = spark.createDataFrame([(1, "all"), (2, "a"), (3, "a.b"), (4, "a.b.c.d"), (5, "b")], "rule int, scope string")
    assert rows_of(R.scope_join(items, rules, "section", "scope"), "section", "rule") == Counter([("a.b.c", 1), ("a.b.c", 2), ("a.b.c", 3), ("a", 1), ("a", 2), ("ab", 1)])
    old = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "d int, e string")
    new = spark.createDataFrame([(1, "n"), (3, "m")], "d int, e string")
    assert rows_of(R.replace_documents(old, new, "d", True)) == Counter([(1, "n"), (2, "z"), (3, "m")])
    assert rows_of(R.replace_documents(old, new, "d", False)) == Counter([(1, "x"), (1, "y"), (2, "z"), (3, "m")])


def test_flags_and_merges(spark):
    one = spark.range(1)
    flags = R.feature_flags(F.create_map(*map(F.lit, ("a", "false", "b", "yes", "z", "true"))), {"a": True, "b": True, "c": False})
    assert one.select(flags.alias("f")).first()["f"] == {"a": False, "b": True, "c": False}
    merged = R.deep_merge(F.expr("map('p', map('x', 1, 'y', 2), 'q', map('x', 1))"), F.expr("map('p', map('y', 9, 'z', 3), 'r', map('k', 7))"))
    assert one.select(merged.alias("m")).first()["m"] == {"p": {"x": 1, "y": 9, "z": 3}, "q": {"x": 1}, "r": {"k": 7}}


def test_status_folds(spark):
    groups = {1: ["通过", "不适用"], 2: ["不适用", "不适用"], 3: ["证据不足", "通过"], 4: ["证据不足", "发现问题"], 5: ["通过"]}
    df = spark.createDataFrame([(k, s) for k, xs in groups.items() for s in xs], "k int, s string")
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(review.fold_status("s").alias("x")).collect()}
    assert got == {1: "通过", 2: "不适用", 3: "证据不足", 4: "发现问题", 5: "通过"}


def test_results_without_evidence_are_downgraded(spark):
    checks = [("r", "a", "通过", "", 1, None), ("r", "b", "通过", "", 0, None), ("r", "c", "不适用", None, 0, None), ("r", "d", "不适用", "why", 0, None), ("r", "e", "??", "x", 2, None), ("r", "f", "执行失败", "", 0, None), ("s", "a", "发现问题", "", 1, "conflict"), ("t", "a", "通过", "", 3, None)]
    frame = spark.createDataFrame(checks, "run string, module string, status string, reason string, evidence long, kind string")
    expected = spark.createDataFrame([("r", "z"), ("r", "a"), ("t", "a")], "run string, module string")
    folded = review.fold_checks(frame, expected)
    got = {(r["run"], r["module"]): (r["status"], r["kind"]) for r in folded.collect()}
    lacking = ("证据不足", "content_missing")
    assert got == {("r", "a"): ("通过", None), ("r", "b"): lacking, ("r", "c"): lacking, ("r", "d"): ("不适用", None), ("r", "e"): lacking, ("r", "f"): ("执行失败", "execution_error"), ("r", "z"): lacking, ("s", "a"): ("发现问题", "conflict"), ("t", "a"): ("通过", None)}
    assert all((r["action"] is None) == (r["kind"] is None) for r in folded.collect())
    runs = {r["run"]: (r["support"], r["need_manual_review"], r["conflict"]) for r in review.fold_run(folded).collect()}
    assert runs == {"r": (review.SUPPORT[1], True, 0), "s": (review.SUPPORT[0], True, 1), "t": (review.SUPPORT[2], False, 0)}
    assert review.fold_checks(frame.limit(0), expected).count() == 3


def test_attribution_order(spark):
    base = {"label": "", "rule_errors": 0, "fact_errors": 0, "reasoning_errors": 0, "evidence_errors": 0, "missing_items": 0, "hits": 1, "queries": 1, "focus_points": 0, "active_rules": 1, "findings": 0, "error": "", "retrieval_feedback": "", "conclusion_feedback": "", "decision": "", "feedback_text": ""}
    cases = [({"label": "retrieval_miss", "rule_errors": 3}, "query_miss", "rag_issue"), ({"rule_errors": 1}, "rule_mapping_error", "rule_issue"), ({"rule_errors": 1, "feedback_text": "法规"}, "missing_regulatory_basis", "rule_issue"), ({"evidence_errors": 1, "hits": 0}, "query_miss", "rag_issue"), ({"missing_items": 2, "focus_points": 1}, "focus_point_miss", "agent_issue"), ({"error": "wrong_severity"}, "wrong_severity", "agent_issue"), ({"decision": "rejected", "findings": 2}, "evidence_interpretation_error", "agent_issue"), ({"feedback_text": "太空"}, "wording_not_actionable", "prompt_issue"), ({}, "", "general_issue")]
    frame = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _, _) in enumerate(cases)])
    out = frame.withColumn("sub", F.expr(review.sub_category("error"))).withColumn("root_category", F.expr(review.root_category("sub")))
    got = {r["i"]: (r["sub"], r["root_category"]) for r in out.collect()}
    assert got == {i: (s, r) for i, (_, s, r) in enumerate(cases)}
    routed = {r["i"]: r["routes"] for r in review.routes(out.withColumn("decision", F.lit("valid"))).collect()}
    assert routed[4] == "regression_case" and routed[0].startswith("retrieval_fix") and len(routed) == len(cases)


def test_named_checks(spark):
    found = lambda *names: F.array(*map(F.lit, names)) if names else F.expr("cast(array() as array<string>)")
    fires = lambda *a, **k: spark.range(1).select(review.triggered(*a, **k).alias("x")).first()["x"]
    assert fires("missing_any", ["a", "b"], found("a")) and not fires("missing_any", ["a", "b"], found("a", "b"))
    assert fires("missing_all", ["a", "b"], found()) and not fires("missing_all", ["a", "b"], found("b")) and not fires("missing_all", [], found())
    assert fires("missing_k_of_n", ["a", "b", "c"], found("a"), least=2) and not fires("missing_k_of_n", ["a", "b", "c"], found("a"), least=1)
    assert fires("assay_correction_logic", [], found("reference_standard")) and not fires("assay_correction_logic", [], found("reference_standard", "purity_correction"))
    assert not fires("unheard_of", ["a"], found())


def test_stability(spark):
    rows = spark.createDataFrame([("12月", "5%", False), ("1年", "<5", False), ("2周", "ND", False), (None, "a:1；b:2", False), ("x", None, False), ("0", "7", True)], "t string, r string, u boolean")
    got = [(r["month"], r["value"], r["kind"]) for r in stability.enrich(rows, "t", "r", F.col("u")).collect()]
    assert got == [(12.0, 5.0, "exact"), (12.0, None, "boundary"), (0.5, None, "not_detected"), (None, None, "composite"), (None, None, "qualitative"), (0.0, None, "numeric_uncertain")]
    points = spark.createDataFrame([(1, "含量", "长期", 0.0, 100.0), (1, "含量", "长期", 6.0, 96.0), (1, "含量", "长期", 12.0, 95.0), (2, "含量", "长期", 6.0, 90.0), (3, "含量", "加速", 6.0, 1.0)], "g int, indicator string, condition string, month double, value double")
    criteria = spark.createDataFrame([("项目=含量；适用条件=长期；下降≥5%；依据=任一时间点",), ("说不清",), (None,)], "text string")
    assert rows_of(stability.significant(points, criteria, ["g"]), "g", "month", "status") == Counter([(1, 6.0, "通过"), (1, 12.0, "发现问题"), (2, 6.0, "证据不足")])
    judged = spark.createDataFrame([(1, False, True, False), (1, True, True, False), (2, None, False, False), (3, True, True, True), (4, True, True, False), (5, None, True, False)], "k int, w boolean, n boolean, near boolean")
    assert {r["k"]: r["x"] for r in judged.groupBy("k").agg(stability.risk("w", "n", "near").alias("x")).collect()} == {1: "高", 2: "待确认", 3: "中", 4: "低", 5: "中"}
    units = spark.createDataFrame([(1, "a", "%"), (1, "a", None), (1, "b", "mg"), (1, "b", "mg")], "k int, i string, u string")
    assert rows_of(stability.split_by_unit(units, ["k"], "i", "u"), "series") == Counter([("a [%]",), ("a [单位未知]",), ("b",), ("b",)])


def test_forms(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    fields = value(forms.labelled_fields(F.lit("前言 规格：5mg；生产企业: 甲（有效期：24月） 【贮藏】 阴凉；"), ["规格", "生产企业", "有效期", "贮藏", "企业"]))
    assert [(f["label"], f["value"]) for f in fields] == [("规格", "5mg"), ("生产企业", "甲（"), ("有效期", "24月）"), ("贮藏", "阴凉")]
    assert value(forms.labelled_fields(F.lit(None), ["a"])) == [] and value(forms.labelled_fields(F.lit("没有"), ["a"])) == []
    assert [value(forms.option_state(F.lit("☑非处方药 □处方药"), o, ["处方药", "非处方药"])) for o in ("非处方药", "处方药")] == ["selected", "open"]
    assert [value(forms.validity(F.lit(t))) for t in ("2 年", "1年6个月", "18月", "约18月", None)] == ["24", "18", "18", "约18月", ""]
    assert value(forms.header_role(F.lit(None))) == "" and value(forms.header_role(F.lit("Test Item"))) == "indicator"
    table = F.array(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "cc")), F.array(*map(F.lit, "ddde")))
    assert value(forms.collapse_columns(table)) == [["a", "b", ""], ["c", "", ""], ["d", "d", "e"]]
    assert value(forms.joined_header(F.array(F.array(*map(F.lit, ("a", "", "c"))), F.array(*map(F.lit, ("a", "b")))))) == ["a", "b", "c"]
    same = lambda a, b: value(forms.continues(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert same("abc", "abc") and same("abc", "abx") and not same("abc", "axy") and not same("ab", "ax") and not same("abc", "ab")
    assert [x["name"] for x in value(forms.planned_items(F.lit("性状、含量（3、6月）；12月；水分")))] == ["性状", "含量", "水分"]
    split = value(forms.fill_volumes(F.lit("5mg（每瓶 10 ml，每支2g）")))
    assert split["volumes"] == ["每瓶10ml", "每支2g"]


def test_trees(spark):
    catalog = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (4, 3), (5, 2)], "node int, parent int")
    leaves = spark.createDataFrame([(4,), (4,), (2,)], "node int")
    assert rows_of(trees.ancestors(leaves, catalog)) == Counter([(4,), (3,), (1,), (0,), (2,)])
    with pytest.raises(ValueError):
        trees.ancestors(leaves, spark.createDataFrame([(4, 1000)] + [(1000 + i, 1001 + i) for i in range(9)], "node int, parent int"), deepest=3)
    docs = spark.createDataFrame([(1, '{"a": {"b": ["x", "y", "x"], "c": "z"}, "n": 5}'), (2, "[]"), (3, '"top"')], "k int, body string")
    assert {(r["k"], r["path"], r["depth"], tuple(r["texts"])) for r in trees.walk_json(docs, "k", "body").collect()} == {(1, "a.b", 2, ("x", "y")), (1, "a.c", 2, ("z",)), (3, "", 0, ("top",))}


def test_line_changes_rebuild_the_text(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(30)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))] + [(99, None, "a")]
    got = trees.line_changes(spark.createDataFrame(pairs, "k int, a string, b string"), "k", "a", "b").collect()
    for k, a, b in pairs:
        old, new = (a or "").split("\n"), b.split("\n")
        out, at = [], 0
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: (r["a0"], r["b0"])):
            out += old[at : r["a0"]] + new[r["b0"] : r["b1"]]
            at = r["a1"]
        assert out + old[at:] == new


def test_pieces_and_traces(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    text = "".join(chr(97 + i % 26) for i in range(257))
    pieces = value(chunks.overlapping(F.lit(text), 100, 20))
    assert pieces == [text[0:100], text[80:180], text[160:260]] and value(chunks.overlapping(F.lit(""), 100, 20)) == [""]
    packed = value(chunks.pack(F.array(*map(F.lit, ("aaa", "bb", "cccccc", "", "d"))), 6))
    assert (packed["packs"], packed["longest"]) == (3, 6)
    kept, spilled = traces.shrink(spark.createDataFrame([(1, "x" * 50), (2, "y" * 500), (3, "語" * 500), (4, None)], "i int, t string"), "t", 200, 100, 10)
    assert {r["i"]: r["form"] for r in kept.collect() if r["i"] < 4} == {1: "full", 2: "minimal", 3: "ultra"}
    assert rows_of(spilled, "i") == Counter([(2,), (3,)])


def test_plugs(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "i int, t string")
    plug.register_model("upper", lambda s: s.map(lambda t: None if t is None else t.upper()))
    assert [r["x"] for r in docs.select(plug.model("upper")(F.col("t")).alias("x")).collect()] == ["AB", "", None]
    assert {r["x"] for r in docs.select(plug.model("nobody")(F.col("t")).alias("x")).collect()} == {None}
    v = {r["i"]: r["v"] for r in docs.select("i", plug.embedder(4)(F.col("t")).alias("v")).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and v[2] == [0.0] * 4 and v[3] is None
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "i int, xs array<string>")
    assert {r["i"]: r["mapped"] for r in plug.parallel_map(lists, "xs", str.upper).collect()} == {1: ["A", "B"], 2: [], 3: None}


def test_broken_word_files_do_not_stop_others(spark):
    from quillspark.sources import docx

    files = spark.createDataFrame([(1, bytearray(b"not a zip")), (2, bytearray(b""))], "k int, content binary")
    assert rows_of(docx.blocks(files, "k", "content"), "k", "kind", "text") == Counter([(1, "error", "BadZipFile"), (2, "error", "BadZipFile")])
