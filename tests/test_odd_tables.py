"""Queries against their SQL on small tables made to differ: missing values, repeated keys, rare letters."""

from datetime import datetime

from quillspark.operators import relational as R
from quillspark.plans import registry


def both(spark, root, name, **tables):
    """The rows of a query and of its SQL over tables of (rows, schema), as sorted lists."""
    import duckdb

    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(root))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    return order(got.collect()), order(con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_packets_without_sections(spark, tmp_path):
    day = lambda n: None if n is None else datetime(2024, 1, n)
    orders = [(1, i, day(d), 10.0 * i, "1-URGENT" if i % 2 else "5-LOW", "O") for i, d in enumerate([None, 3, 3, 1, 2, 9, 8, 7])]
    orders += [(2, 20, day(1), None, "1-URGENT", "F"), (2, None, day(1), 5.0, "1-URGENT", "F"), (3, 30, None, 1.0, "5-LOW", "F"), (None, 40, day(1), 1.0, "1-URGENT", "F")]
    customers = [(1,), (2,), (3,), (3,), (5,), (5,), (None,)]
    schema = "o_custkey long, o_orderkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string, o_orderstatus string"
    got, want = both(spark, tmp_path, "ev_packets", customer=(customers, "c_custkey long"), orders=(orders, schema))
    assert got == want and (5, 0, None, "confirmed", 0) in got


def test_credit_code_of_rare_letters(spark, tmp_path):
    run = "abcdefgh123456789"
    pages = [run + "x", run + "ß", "ﬀ" + run, run + "ſı", "ŉ" + run, run + "ẞ" + run, "ß" + run + "zz<b>", run, "", None, "İ" + run + "K", "é " + 3 * run + "\n" + run]
    got, want = both(spark, tmp_path, "str_credit_code", pages=(list(enumerate(pages)), "page_id long, html string"))
    assert got == want and (3, run.upper() + "SI") in got


def test_credit_code_by_label_then_by_word(spark, tmp_path):
    import re

    code, other = "91330183MA2CG7XR9P", "91330701MA2EA5925G"
    label = "统一社会信用代码"
    pages = [f"{name}{gap}{code}" for name in (label + "/组织机构代码", label, "社会信用代码") for gap in ("", "：", ":;", " \u3000\n", "\xa0\x1c\u2009\x0b")]
    pages += [label + "：" + (code + other)[:n] for n in (14, 15, 17, 19, 25, 26)]
    pages += [f"{other} {label}：{code}", f"{label}：无 {other} 社会信用代码 {code[:15]}", f"{label}/组织机构代码 / {code}", f"组织机构代码：{code}", f"{label}：{code.lower()} {other}", f"{label}：</td><td>{code}"]
    pages += [f"telecommunications {code}", f"{code}1 {other}", f"码{code} {other}", f"_{code} {code}é {other}", f"𠀀{code} ({other})", f"²{code}-{other}", f"{code}\n", f"\n{code} {other}", f"x {code} {other} y", "<b>" + code + "</b>"]
    pages += [label + "：" * 100_000 + code, label + " " * 100_000, (label + "：") * 20_000, f"{code}{other}", "", None]

    def reference(text):
        for pattern in (r"(?:统一社会信用代码/组织机构代码|统一社会信用代码|社会信用代码)[:：;\s]*([0-9A-Z]{15,25})", r"\b([0-9A-Z]{18})\b"):
            if m := re.search(pattern, text or ""):
                return m.group(1)

    got, want = both(spark, tmp_path, "str_credit_code", pages=(list(enumerate(pages)), "page_id long, html string"))
    assert got == want
    named = {i: reference(text) for i, text in enumerate(pages) if reference(text)}
    assert len(named) > 35 and {i: c for i, c in got if i in named} == named


def test_boxes_of_odd_sizes(spark, tmp_path):
    prices = [900.0, 939.9, 940.0, 940.1, 980.0, -1.0, -0.0, 0.0, float("nan"), float("nan"), float("inf"), float("-inf"), 1e300, None]
    parts = [(len(prices) * k + i, None if k == 4 else "ab"[k % 2], [10, 13, 14, None][k % 4] if i % 3 else 12, x) for k in range(6) for i, x in enumerate(prices)]
    parts += [(None, "a", 12, 940.0), (1, "a", 12, 940.0), (1, "a", 12, 940.0), *((1000 + i, "c", 10, 940.0) for i in range(300))]
    got, want = both(spark, tmp_path, "join_spatial", part=(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double"))
    assert got == want and len(got) > 300 * 299


def _joined(plan) -> int:
    """The most rows that a join of an executed plan has given out."""
    name, below = plan.nodeName(), [plan.children().apply(i) for i in range(plan.children().size())]
    if name == "AdaptiveSparkPlan":
        below.append(plan.executedPlan())
    elif name.endswith("QueryStage"):
        below.append(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *map(_joined, below)])


def test_equal_boxes_meet_once(spark):
    boxes = spark.range(400).selectExpr("id AS o", "1 AS k", "0.0D AS x0", "9.0D AS x1", "id % 2 AS y0", "9.0D AS y1")
    inside = boxes.selectExpr("o AS i", "k", "x0 + 1 AS u0", "x1 - 1 AS u1", "y0 + 0.5D AS v0", "y1 - 1 AS v1")
    pairs = R.box_join(boxes, inside, ["k"], 5.0, 5.0)
    assert pairs.columns[0] == "k" and len(pairs.collect()) == 3 * 200 * 200
    assert _joined(pairs._jdf.queryExecution().executedPlan()) <= 2 * 400
