"""Queries of joins and aggregates by strategy, sources and sinks, event time, and user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import plug
from quillspark.operators import chunks
from quillspark.operators import relational as R
from quillspark.plans.registry import register
from quillspark.sources import docx, exchange
from quillspark.sources import registry as readers
from quillspark.sources.tables import table
from quillspark.streaming import tasks as streams

#: Rows up to which a side of short rows may be sent to all; larger ones are shuffled.
SMALL = 10_000


@register("join_asof", "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def join_asof(spark: SparkSession, root: str) -> DataFrame:
    """Every purchase with the user's last click at or before it."""
    events = table(spark, root, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    clicks = events.filter("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click_id"))
    return R.asof_join(bought, clicks, ["user_id"], "at", "click_id", 6 * 3600 * 10**6).select("event_id", "click_id")


@register("join_broadcast", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: SparkSession, root: str) -> DataFrame:
    """Dimensions are sent to all if their size allows, else joined by shuffle."""
    dims = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    dims = F.broadcast(dims) if dims.count() <= SMALL else dims.hint("merge")
    return table(spark, root, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@register("join_merge_hash", "SELECT c_custkey, o_orderpriority, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_merge_hash(spark: SparkSession, root: str) -> DataFrame:
    """Two large sides by sorting, then a middling one by hashing each shuffled part."""
    lines = table(spark, root, "lineitem").select("l_orderkey")
    joined = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    counts = joined.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("lines"))
    return counts.join(table(spark, root, "customer").select("c_custkey").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderpriority", "lines")


@register("agg_cube", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.sum("l_quantity").cast("double").alias("quantity"))


@register("agg_rollup", "SELECT o_orderpriority, o_orderstatus, grouping_id(o_orderpriority, o_orderstatus) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def agg_rollup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


_SETS = "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM {documents} GROUP BY GROUPING SETS ((lang), (source), ())"


@register("agg_grouping_sets", _SETS.format(documents="documents"))
def agg_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    return exchange.query(spark, _SETS, documents=table(spark, root, "documents"))


@register("agg_approx", "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1")
def agg_approx(spark: SparkSession, root: str) -> DataFrame:
    """Distinct users exactly, and whether the sketch is within a twentieth of that."""
    rows = table(spark, root, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.01).alias("about"))
    return rows.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users")).alias("close"))


@register("win_running_pack", """WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, 0::BIGINT AS held, 0::BIGINT AS packs, 0::BIGINT AS longest FROM p UNION ALL
SELECT w.doc_id, p.n, CASE WHEN w.packs > 0 AND w.held + length(p.s) + 1 <= 400 THEN w.held + length(p.s) + 1 ELSE length(p.s) END,
CASE WHEN w.packs > 0 AND w.held + length(p.s) + 1 <= 400 THEN w.packs ELSE w.packs + 1 END,
greatest(w.longest, CASE WHEN w.packs > 0 AND w.held + length(p.s) + 1 <= 400 THEN w.held + length(p.s) + 1 ELSE length(p.s) END) FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.n = w.n + 1)
SELECT doc_id, max(packs) AS packs, max(longest) AS longest FROM walk GROUP BY doc_id""")
def win_running_pack(spark: SparkSession, root: str) -> DataFrame:
    """Lines packed while they fit in 400 characters with a space between."""
    packed = chunks.pack(F.split("text", "\n"), 400)
    return table(spark, root, "documents").select("doc_id", packed["packs"].alias("packs"), packed["longest"].alias("longest"))


@register("src_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def src_jsonl(spark: SparkSession, root: str) -> DataFrame:
    rows, path = table(spark, root, "conversations").select("conv_id", "turn", "role", "text"), exchange.scratch(spark)
    exchange.write_jsonl(rows, path)
    return exchange.read_jsonl(spark, path, rows.schema)


@register("src_txt", r"SELECT replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') AS line, count(*) AS n FROM benchmark GROUP BY 1")
def src_txt(spark: SparkSession, root: str) -> DataFrame:
    """Texts written as lines and read by the reader of their extension."""
    path = exchange.scratch(spark) + ".txt"
    exchange.write_texts(table(spark, root, "benchmark"), "text", path)
    whole = readers.read(spark, path)
    return whole.select(F.explode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@register("src_registry", "SELECT * FROM (SELECT 'benchmark' AS name, 'parquet' AS kind, count(*) AS rows FROM benchmark UNION ALL SELECT 'nation', 'jsonl', count(*) FROM nation UNION ALL SELECT 'region', 'csv', count(*) FROM region)")
def src_registry(spark: SparkSession, root: str) -> DataFrame:
    """Files of three kinds, each by the reader of its extension."""
    folder = exchange.scratch(spark)
    table(spark, root, "nation").write.json(f"{folder}/nation.jsonl")
    table(spark, root, "region").write.option("header", "true").csv(f"{folder}/region.csv")
    return exchange.read_any(spark, {"benchmark": f"{root}/benchmark.parquet", "nation": f"{folder}/nation.jsonl", "region": f"{folder}/region.csv"})


_SQL = "SELECT c_mktsegment, count(*) AS orders, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P' GROUP BY c_mktsegment"


@register("src_sql", _SQL.format(customer="customer", orders="orders"))
def src_sql(spark: SparkSession, root: str) -> DataFrame:
    return exchange.query(spark, _SQL, customer=table(spark, root, "customer"), orders=table(spark, root, "orders"))


_MATCH = "SELECT doc_id FROM {documents} WHERE (CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'mail') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 1 ELSE 0 END) >= 2"


@register("src_es_sql", _MATCH.format(documents="documents"))
def src_es_sql(spark: SparkSession, root: str) -> DataFrame:
    """A LIKE on tokens as a match of at least three in ten of its words, two of four."""
    return exchange.query(spark, _MATCH, documents=table(spark, root, "documents"))


@register("snk_vector_snapshot", "SELECT vec_id, label, len(embedding) AS width FROM embeddings")
def snk_vector_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Exported to JSON and imported over the rows it came from."""
    rows, path = table(spark, root, "embeddings").select("vec_id", "label", "embedding"), exchange.scratch(spark)
    exchange.export_snapshot(rows, path)
    back = exchange.import_snapshot(rows, path, "vec_id", replace=False)
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("width"))


@register("rag_index", "SELECT doc_id, lang, count(*) AS entries FROM (SELECT doc_id, lang, unnest(range(1, greatest(length(text), 1) + 1, 1200)) FROM documents WHERE text <> '') GROUP BY ALL")
def rag_index(spark: SparkSession, root: str) -> DataFrame:
    """Entries of windows of 1,200 characters; documents of one language are indexed again, which replaces theirs."""
    docs = table(spark, root, "documents").filter("text != ''")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(1200)))
    entries = lambda rows: rows.select("doc_id", "lang", starts.alias("start"))
    again = R.replace_documents(entries(docs), entries(docs.filter("lang = 'en'")), "doc_id", force=True)
    kept = R.replace_documents(again, entries(docs.filter("lang = 'de'")), "doc_id", force=False)
    return kept.groupBy("doc_id", "lang").agg(F.count("*").alias("entries"))


def _events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@register("st_late_data", "WITH e AS (SELECT event_id, epoch_us(ts) AS us, event_id // 200 AS b FROM events), t AS (SELECT b, max(us) AS top FROM e GROUP BY 1), m AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS mark FROM t) SELECT event_id, coalesce(us < mark, false) AS late FROM e JOIN m USING (b)")
def st_late_data(spark: SparkSession, root: str) -> DataFrame:
    """Events in order of arrival, 200 a batch; late is what comes ten minutes behind all batches before."""
    return R.late_rows(_events(spark, root).select("event_id", "at"), F.expr("event_id div 200"), "at", 600 * 10**6).select("event_id", "late")


@register("st_watermark", "SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def st_watermark(spark: SparkSession, root: str) -> DataFrame:
    """A real stream in append mode: windows come out once the watermark has passed their end."""
    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = exchange.scratch(spark)
    query = streams.tumbling_counts(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/log").format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{folder}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("src_redis_stream", "SELECT event_id, user_id, event_type FROM events")
def src_redis_stream(spark: SparkSession, root: str) -> DataFrame:
    """A folder as a stream, one file a batch; the checkpoint holds what was read, as a consumer group does."""
    folder = exchange.scratch(spark)
    rows = table(spark, root, "events").select("event_id", "user_id", "event_type")
    rows.repartition(4, "event_id").write.parquet(f"{folder}/in")
    streams.copy_once(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out")


@register("st_redis_ack", "SELECT event_id, 1::BIGINT AS deliveries FROM events")
def st_redis_ack(spark: SparkSession, root: str) -> DataFrame:
    """Read twice with the same checkpoint: what was acknowledged isn't delivered again."""
    folder = exchange.scratch(spark)
    rows = table(spark, root, "events").select("event_id")
    rows.filter("event_id % 2 = 0").write.parquet(f"{folder}/in")
    streams.copy_once(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/log")
    rows.filter("event_id % 2 = 1").write.mode("append").parquet(f"{folder}/in")
    streams.copy_once(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out").groupBy("event_id").agg(F.count("*").alias("deliveries"))


@register("st_progress_ttl", "WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY ts DESC, user_id) AS nth FROM l WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND) SELECT user_id FROM k WHERE nth <= 2000")
def st_progress_ttl(spark: SparkSession, root: str) -> DataFrame:
    """The newest 2,000 entries that aren't older than 7,200 seconds; the bound is the feature."""
    last = _events(spark, root).groupBy("user_id").agg(F.max("at").alias("at"))
    now = last.agg(F.max("at").alias("now"))  # one row
    live = last.crossJoin(F.broadcast(now)).filter("at >= now - 7200000000")
    return live.orderBy(F.desc("at"), "user_id").limit(2000).select("user_id")


@register("st_run_sse", "SELECT event_id, 'data: {\"seq\":' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) || ',\"type\":\"' || event_type || '\"}' AS frame FROM events")
def st_run_sse(spark: SparkSession, root: str) -> DataFrame:
    """Frames of each run's stream, numbered in order."""
    seq = R.nth_per(_events(spark, root), ["user_id"], [F.col("at"), F.col("event_id")], 2**31 - 1, "seq")
    frame = F.concat(F.lit('data: {"seq":'), F.col("seq").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    return seq.select("event_id", frame.alias("frame"))


@register("udf_parser_register", "SELECT r_regionkey, r_name FROM region")
def udf_parser_register(spark: SparkSession, root: str) -> DataFrame:
    """A reader of the user's own for an extension of their own."""
    readers.register_reader("pipes", lambda s, path: s.read.option("sep", "|").schema("r_regionkey long, r_name string").csv(path))
    path = exchange.scratch(spark) + ".pipes"
    table(spark, root, "region").select("r_regionkey", "r_name").write.option("sep", "|").csv(path)
    return readers.read(spark, path)


@register("udf_parallel_map", "SELECT conv_id, string_agg(upper(role), ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def udf_parallel_map(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("xs"))
    listed = rows.select("conv_id", F.transform("xs", lambda x: x["role"]).alias("roles"))
    return plug.parallel_map(listed, "roles", str.upper).select("conv_id", F.array_join("mapped", ",").alias("roles"))


@register("udf_embed", "SELECT item_id, 8 AS width, true AS unit FROM benchmark")
def udf_embed(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "benchmark").select("item_id", plug.embedder(8)(F.col("text")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("item_id", F.size("v").alias("width"), (F.abs(length - 1) < 1e-9).alias("unit"))


@register("udf_model_factory", "SELECT item_id, reverse(text) AS answer, NULL::VARCHAR AS nothing FROM benchmark")
def udf_model_factory(spark: SparkSession, root: str) -> DataFrame:
    """A model given for one task; the other task has none, and the null model answers."""
    plug.register_model("reverse", lambda texts: texts.map(lambda t: t[::-1]))
    return table(spark, root, "benchmark").select("item_id", plug.model("reverse")(F.col("text")).alias("answer"), plug.model("rerank")(F.col("text")).alias("nothing"))


@register("udtf_chunk", "SELECT item_id, len(range(0, greatest(length(text) - 20, 1), 80)) AS pieces FROM benchmark WHERE text <> ''")
def udtf_chunk(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of 100 characters that overlap by 20, from a Python table function."""
    rows = table(spark, root, "benchmark").select("item_id", "text")
    cut = rows.lateralJoin(plug.windows()(F.col("text").outer(), F.lit(100), F.lit(20)))
    return cut.groupBy("item_id").agg(F.count("*").alias("pieces"))


@register("udf_user_sql", "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN value / (user_id % 5) ELSE 0 END AS ratio, greatest(0.0, least(1.0, value - 50)) AS part FROM events")
def udf_user_sql(spark: SparkSession, root: str) -> DataFrame:
    plug.register_sql(spark)
    return exchange.query(spark, "SELECT event_id, ratio0(value, user_id % 5) AS ratio, clamp01(value - 50) AS part FROM {events}", events=table(spark, root, "events"))


@register("udaf_metrics", "SELECT user_id, regr_slope(value, n) AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS n FROM events) GROUP BY 1")
def udaf_metrics(spark: SparkSession, root: str) -> DataFrame:
    """A metric over each group's rows, from built-in aggregates that combine before the shuffle."""
    rows = R.nth_per(_events(spark, root), ["user_id"], [F.col("at"), F.col("event_id")], 2**31 - 1, "n")
    return rows.groupBy("user_id").agg(F.regr_slope("value", F.col("n").cast("double")).alias("slope"))


_FLAGS = {"rag": True, "rules": True, "memory": False, "feedback": True, "rerank": False, "trace": True}


@register("prj_feature_flags", "SELECT c_custkey, c_nationkey % 2 = 0 AS rag, true AS rules, CASE WHEN c_nationkey % 3 = 0 THEN true ELSE false END AS memory, true AS feedback, false AS rerank, c_custkey % 2 = 1 AS trace FROM customer")
def prj_feature_flags(spark: SparkSession, root: str) -> DataFrame:
    """Overrides of unknown keys or other values than true and false have no effect."""
    said = lambda c: c.cast("string")
    over = F.create_map(F.lit("rag"), said(F.col("c_nationkey") % 2 == 0), F.lit("rules"), F.lit("no"), F.lit("memory"), F.when(F.col("c_nationkey") % 3 == 0, "true").otherwise("maybe"), F.lit("trace"), said(F.col("c_custkey") % 2 == 1), F.lit("other"), F.lit("true"))
    flags = R.feature_flags(over, _FLAGS)
    return table(spark, root, "customer").select("c_custkey", flags.alias("f")).select("c_custkey", *[F.col("f")[k].alias(k) for k in _FLAGS])


@register("map_deep_merge", "SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS state, n_regionkey::VARCHAR AS region FROM nation")
def map_deep_merge(spark: SparkSession, root: str) -> DataFrame:
    a = F.create_map(F.lit("own"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("state"), F.lit("old")))
    b = F.create_map(F.lit("own"), F.create_map(F.lit("state"), F.when(F.col("n_nationkey") % 2 == 0, "new")), F.lit("more"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")))
    m = table(spark, root, "nation").select("n_nationkey", R.deep_merge(a, b).alias("m"))
    return m.select("n_nationkey", F.col("m")["own"]["name"].alias("name"), F.col("m")["own"]["state"].alias("state"), F.col("m")["more"]["region"].alias("region"))


def _word_files(rows: DataFrame) -> DataFrame:
    """Word documents made of rows (key, title, cells): a heading, a line and a table whose first column is merged."""

    def run(frames):
        import io
        import zipfile

        import pandas as pd

        space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        line = lambda text, style="": f"<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"
        cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{line(text)}</w:tc>"
        for frame in frames:
            out = []
            for title, cells in zip(frame["title"], frame["cells"], strict=True):
                first = '<w:vMerge w:val="restart"/>'
                body = [f"<w:tr>{cell(title if i == 0 else '', first if i == 0 else '<w:vMerge/>')}{cell(c)}</w:tr>" for i, c in enumerate(cells)]
                last = f"<w:tr>{cell('total', '<w:gridSpan w:val=\"2\"/>')}</w:tr>"
                style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
                xml = f"<w:document {space}><w:body>{line(title, style)}{line('about ' + title)}<w:tbl>{''.join(body)}{last}</w:tbl></w:body></w:document>"
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("word/document.xml", xml)
                out.append(held.getvalue())
            yield pd.DataFrame({"key": frame["key"], "content": out})

    return rows.mapInPandas(run, "key int, content binary")


@register("src_docx", "SELECT r_regionkey AS key, 0 AS pos, 'heading' AS kind, 1 AS level, r_name AS text FROM region UNION ALL SELECT r_regionkey, 1, 'text', 0, 'about ' || r_name FROM region UNION ALL SELECT n_regionkey, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'row', 0, r_name || ' | ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_regionkey, 2 + count(*), 'row', 0, 'total | total' FROM nation GROUP BY 1")
def src_docx(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"))
    joined = table(spark, root, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    files = _word_files(joined.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("title"), F.transform("xs", lambda x: x["n_name"]).alias("cells")))
    return docx.blocks(files, "key", "content").select("key", F.col("pos").cast("long").alias("pos"), "kind", "level", "text")


@register("snk_es_bulk", "SELECT doc_id, CASE WHEN n_chars > 8000 THEN 'too_large' WHEN trim(text) = '' THEN 'empty' END AS error FROM documents")
def snk_es_bulk(spark: SparkSession, root: str) -> DataFrame:
    """Rows that can be indexed are written; the result has an error for each of the others."""
    why = F.when(F.col("n_chars") > 8000, "too_large").when(F.trim("text") == "", "empty")
    marked = table(spark, root, "documents").withColumn("error", why)
    marked.filter("error IS NULL").drop("error").write.parquet(exchange.scratch(spark))
    return marked.select("doc_id", "error")


@register("snk_report", "SELECT source, '# ' || source || chr(10) || count(*) || ' documents' || chr(10) || string_agg(DISTINCT '- ' || lang, chr(10) ORDER BY '- ' || lang) AS report FROM documents GROUP BY source")
def snk_report(spark: SparkSession, root: str) -> DataFrame:
    """One Markdown report a source."""
    langs = F.array_join(F.transform(F.sort_array(F.collect_set("lang")), lambda x: F.concat(F.lit("- "), x)), "\n")
    return table(spark, root, "documents").groupBy("source").agg(F.concat(F.lit("# "), F.first("source"), F.lit("\n"), F.count("*").cast("string"), F.lit(" documents\n"), langs).alias("report"))


@register("src_pages_loop", "WITH p AS (SELECT *, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 10 AS page FROM conversations) SELECT role, page, count(*) AS items FROM p WHERE page < 20 GROUP BY ALL")
def src_pages_loop(spark: SparkSession, root: str) -> DataFrame:
    """Pages of ten items of each listing, until there are none or twenty pages are read; the bound is the feature."""
    numbered = R.nth_per(table(spark, root, "conversations"), ["role"], [F.col("conv_id"), F.col("turn")], 10 * 20, "n")
    return numbered.groupBy("role", F.expr("(n - 1) div 10").alias("page")).agg(F.count("*").alias("items"))
