"""Queries of text functions, over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.registry import register
from quillspark.sources.tables import table

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_LINE = lambda x: _STRIP(f"regexp_replace({x}, '\\s+', ' ', 'g')")
_SENTENCES = (
    lambda x: f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '\\n{{2,}}', chr(30), 'g'), '([。！？；.!?;])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: {_STRIP('s')}), lambda s: s <> '')"
)


def _simple(name: str, sql: str, expression, source: str = "documents", key: str = "doc_id") -> None:
    """A query that computes one value of each text."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        rows = table(spark, root, source)
        return rows.select(key, expression(F.col("text")).alias("value"))

    register(name, f"SELECT {key}, {sql} AS value FROM {source}")(run)


_simple("str_norm_ws", _STRIP(r"regexp_replace(regexp_replace(replace(replace(text, chr(12288), ' '), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"), T.norm_ws)
_simple("str_sentence_split", f"array_to_string({_SENTENCES('text')}, '|')", lambda c: F.array_join(T.sentences(c), "|"))
_simple("prj_truncate", "CASE WHEN length(text) > 500 THEN left(text, 500) || '...(truncated)' ELSE text END", lambda c: T.truncate(c, 500))
_simple("str_summary", f"CASE WHEN length({_LINE('text')}) <= 120 THEN {_LINE('text')} ELSE rtrim(left({_LINE('text')}, 117)) || '...' END", T.summary)
_simple(
    "str_doc_summary",
    f"(SELECT CASE WHEN length(s) <= 400 THEN s ELSE rtrim(left(s, 397)) || '...' END FROM (SELECT trim(source || ' ' || array_to_string(list_slice(list_filter(list_transform({_SENTENCES('text')}, lambda p: {_LINE('p')}), lambda p: p <> ''), 1, 4), ' ')) AS s))",
    lambda c: T.doc_summary(F.col("source"), c),
)
_simple("str_query_terms", r"array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]+'), ' ')", lambda c: F.array_join(T.query_terms(c), " "), "benchmark", "item_id")
_simple("str_match_norm", r"regexp_replace(lower(" + _STRIP("text") + r'''), '[\s\x{3000}；;，,。、“”"''（）()【】\[\]：:、\\/_-]+', '', 'g')''', T.match_norm)
_simple("str_safe_name", "left(regexp_replace(text, '[^0-9A-Za-z._-]+', '_', 'g'), 80)", T.safe_name)
_simple("str_chunk_hard", f"array_to_string(list_filter(list_transform(range(1, greatest(length({_STRIP('text')}), 1) + 1, 250), lambda i: {_STRIP('substring(' + _STRIP('text') + ', i, 250)')}), lambda p: p <> ''), '|')", lambda c: F.array_join(T.slices(c, 250), "|"))
_simple("str_chunk_fixed", "array_to_string(list_transform(range(1, greatest(length(text), 1) + 1, 5000), lambda i: substring(text, i, 5000)), '|')", lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(5000)), lambda s: F.substring(c, s, F.lit(5000))), "|"))
_simple("math_length_reward", "least(1.0, length(text) / 1000.0)::DOUBLE", lambda c: F.least(F.lit(1.0), F.length(c) / 1000))
_simple("json_size", "strlen(to_json({'id': doc_id, 't': source})::VARCHAR)", lambda c: F.octet_length(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("t")))))
_simple("math_keyword_reward", "((contains(text, 'the')::INT + contains(text, 'tion')::INT + contains(text, 'zu')::INT) / 3.0)::DOUBLE", lambda c: (c.contains("the").cast("int") + c.contains("tion").cast("int") + c.contains("zu").cast("int")) / 3)
_simple("rank_lexical", "((contains(lower(text), 'the')::INT + contains(lower(text), 'heit')::INT + contains(lower(text), 'ción')::INT + contains(lower(text), 'eau')::INT) / 4.0)::DOUBLE", lambda c: T.contained_share(["the", "heit", "ción", "eau"], c))
_simple("rank_hash", "(('0x' || left(md5('query' || text), 8))::BIGINT % 1000) / 1000.0::DOUBLE", lambda c: (F.conv(F.substring(F.md5(F.concat(F.lit("query"), c).cast("binary")), 1, 8), 16, 10).cast("long") % 1000) / F.lit(1000.0))
_simple("frag_split", r"(SELECT string_agg(p, '|' ORDER BY o) FROM (SELECT p, min(o) AS o FROM (SELECT regexp_replace(" + _LINE("u") + r", '^[\s，,。.、:：\-]+|[\s，,。.、:：\-]+$', '', 'g') AS p, o FROM (SELECT unnest(string_split_regex(text, '[；;\n]+')) AS u, generate_subscripts(string_split_regex(text, '[；;\n]+'), 1) AS o)) WHERE length(p) >= 2 GROUP BY p))", lambda c: F.nullif(F.array_join(T.fragments(c), "|"), F.lit("")))
_simple("str_dedupe_lines", r"(SELECT string_agg(p, '|' ORDER BY o) FROM (SELECT p, min(o) AS o FROM (SELECT " + _LINE("u") + r" AS p, o FROM (SELECT unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS o)) WHERE p <> '' GROUP BY p))", lambda c: F.nullif(F.array_join(T.distinct_lines(c), "|"), F.lit("")))
_simple("str_is_english", r"(list_sum(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(" + _STRIP("x") + r''', '^[ `a-zA-Z.,'':;/"?<>!\(\)-]')::INT)) / len(string_split(text, chr(10))) > 0.8)''', lambda c: T.is_english(F.split(c, "\n")))
_simple("str_highlight", "array_to_string(list_transform(list_filter(" + _SENTENCES("text") + ", lambda s: regexp_matches(s, '(?i)(idiot|mail)')), lambda s: regexp_replace(s, '(?i)(idiot|mail)', '<em>\\1</em>', 'g')), '...')", lambda c: T.highlight(c, ["idiot", "mail"]))
_simple(
    "str_find_excerpt",
    "CASE WHEN instr(lower(text), 'tion') > 0 THEN " + _STRIP("substring(text, greatest(instr(lower(text), 'tion') - 51, 0) + 1, (instr(lower(text), 'tion') - 1 + 4 + 50 - greatest(instr(lower(text), 'tion') - 51, 0))::INT)")
    + " WHEN instr(lower(text), 'heit') > 0 THEN " + _STRIP("substring(text, greatest(instr(lower(text), 'heit') - 51, 0) + 1, (instr(lower(text), 'heit') - 1 + 4 + 50 - greatest(instr(lower(text), 'heit') - 51, 0))::INT)") + " ELSE '' END",
    lambda c: T.excerpt(c, ["tion", "heit"], 50),
)


@register("str_order_suffix", "SELECT DISTINCT source, CASE WHEN regexp_matches(source, '[0-9]+$') THEN regexp_extract(source, '([0-9]+)$', 1)::BIGINT ELSE 1000000000 END AS chunk_order FROM documents")
def str_order_suffix(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("source", T.order_suffix(F.col("source")).alias("chunk_order")).distinct()


@register("str_tokenize_pharm", r"SELECT item_id, (SELECT string_agg(p, '|' ORDER BY o) FROM (SELECT p, min(o) AS o FROM (SELECT unnest(string_split_regex(trim(text), '[\s,，。；;:：/|()（）\[\]【】]+')) AS p, generate_subscripts(string_split_regex(trim(text), '[\s,，。；;:：/|()（）\[\]【】]+'), 1) AS o) WHERE length(p) >= 2 GROUP BY p ORDER BY o LIMIT 8)) AS tokens FROM benchmark")
def str_tokenize_pharm(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), "|").alias("tokens"))


@register("str_text_quality", r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[.．·…]{3,}', '', 'g'), '\s', '', 'g') AS v FROM documents),
c AS (SELECT doc_id, length(v) AS characters, len(regexp_extract_all(v, '[\x{fffd}\p{Cc}\p{Co}]')) AS abnormal, len(regexp_extract_all(v, '[\p{L}\p{N}]')) AS effective FROM s)
SELECT *, characters > 0 AND abnormal / characters < 0.03 AND effective / characters >= 0.35 AS usable FROM c""")
def str_text_quality(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", T.text_quality(F.col("text")).alias("q")).select("doc_id", "q.*")


@register("agg_keyword_top", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_/-]{2,}')) AS token,
  generate_subscripts(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_/-]{2,}'), 1) AS pos FROM documents),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first_pos FROM t WHERE lower(token) NOT IN ('should','shall','with','from','that','this','into','using','used','content','document','section','chapter','method','result','standard') GROUP BY ALL)
SELECT doc_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM c) WHERE rank <= 8""")
def agg_keyword_top(spark: SparkSession, root: str) -> DataFrame:
    return keyword_top(table(spark, root, "documents"), "doc_id", "text")


def keyword_top(docs: DataFrame, key: str, text_col: str, most: int = 8) -> DataFrame:
    """The most frequent keywords of each text; ties go to the one that occurs first."""
    # Texts are dealt by key once; what is counted and ranked below then stays where it is.
    tokens = docs.select(key, text_col).repartition(key).select(key, F.posexplode(T.all_matches(F.col(text_col), T.KEYWORD_PATTERN)).alias("pos", "token"))
    counted = tokens.filter(~F.lower("token").isin(*T.KEYWORD_STOPS)).groupBy(key, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first_pos"))
    return counted.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select(key, "token", "n", "rank")


_NORM = lambda c: f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[\\s\\x{{3000}}；;，,。、“”\"''（）()【】\\[\\]：:、\\\\/_-]+', '', 'g')"
_OVERLAP = "greatest(CASE WHEN contains(c, q) OR contains(q, c) THEN CASE WHEN least(length(q), length(c)) >= 6 THEN 1.0 ELSE 0.85 END ELSE 0.0 END, len(list_intersect(list_distinct(string_split(q, '')), list_distinct(string_split(c, '')))) / len(list_distinct(string_split(q, ''))))::DOUBLE"


@register("str_char_overlap", f"WITH p AS (SELECT a.conv_id, a.turn, {_NORM('a.text')} AS q, {_NORM('b.text')} AS c FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN q = '' OR c = '' THEN 0 ELSE {_OVERLAP} END, 6) AS score FROM p")
def str_char_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Every turn against the next one of its conversation."""
    rows = table(spark, root, "conversations").select("conv_id", "turn", F.col("text").alias("q"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("q").alias("c"))
    return rows.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.char_overlap(F.col("q"), F.col("c")), 6).alias("score"))


@register("join_must_answer", f"WITH t AS (SELECT conv_id, turn, role, {_NORM('text')} AS x FROM conversations), q AS (SELECT conv_id, turn, x AS q FROM t WHERE role = 'user'), s AS (SELECT q.conv_id, q.turn, {_OVERLAP} AS s FROM q JOIN (SELECT conv_id, x AS c FROM t WHERE role = 'assistant') a ON a.conv_id = q.conv_id WHERE q <> '' AND c <> '') SELECT q.conv_id, q.turn, count(s.s) AS answers, coalesce(round(max(s.s), 6), 0) AS best, count(s.s) > 0 AS covered FROM q LEFT JOIN s ON s.conv_id = q.conv_id AND s.turn = q.turn AND s.s >= 0.42 GROUP BY ALL")
def join_must_answer(spark: SparkSession, root: str) -> DataFrame:
    """Every question of a run (conversation) against the run's tasks: those with a score of 0.42 or more answer it."""
    rows = table(spark, root, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    tasks = rows.filter("role = 'assistant'").select("conv_id", F.col("text").alias("c"))
    scored = asked.join(tasks, "conv_id").select("conv_id", "turn", T.char_overlap(F.col("q"), F.col("c")).alias("s")).filter("s >= 0.42")
    best = scored.groupBy("conv_id", "turn").agg(F.count("*").alias("answers"), F.max("s").alias("best"))
    joined = asked.select("conv_id", "turn").join(best, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.coalesce("answers", F.lit(0)).alias("answers"), F.coalesce(F.round("best", 6), F.lit(0.0)).alias("best"), F.col("answers").isNotNull().alias("covered"))