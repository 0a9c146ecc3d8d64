"""Chunk folds against a plain model, Markdown sections, streaming twins against their batch forms."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import chunks, tasks
from quillspark.sources import registry
from quillspark.streaming import tasks as streams


def _texts() -> list[str]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.choice([1, 3, 12, 90]))) + rng.choice([".", "!", "。", ";"])
    return ["", "  ", "one.", *[rng.choice([" ", "\n\n", "  "]).join(sentence() for _ in range(rng.randint(1, 30))) for _ in range(60)]]


def test_split_long_keeps_all_words_within_the_limit(spark):
    texts = _texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", chunks.split_long(F.col("text"), 120).alias("s")).collect()
    for r in rows:
        joined = "".join("".join(r["s"]).split())
        assert joined == "".join(texts[r["id"]].split())
        assert all(0 < len(s) <= 120 and s == s.strip() for s in r["s"])


def test_merge_small(spark):
    cases = [([], []), (["x"], ["x"]), (["a" * 5, "b" * 5], ["aaaaa bbbbb"]), (["a" * 30, "b" * 5], ["a" * 30 + " bbbbb"]), (["a" * 30, "b" * 30], ["a" * 30, "b" * 30]), (["a" * 5, "b" * 30, "c" * 5], ["aaaaa " + "b" * 30 + " ccccc"])]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, s array<string>")
    got = {r["id"]: r["m"] for r in rows.select("id", chunks.merge_small(F.col("s"), 10, 60).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_markdown_leaf_sections(spark):
    text = "intro\n# A\nalpha\n## A1\none\n## A2\ntwo\n### A2a\nthree\n# B\n\n## B1\nfour\n"
    rows = chunks.markdown_sections(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), "id", "text").orderBy("section").collect()
    assert [(r["path"], r["body"]) for r in rows] == [
        ([], "intro"),
        (["A", "A1"], "alpha\n\none"),
        (["A", "A2", "A2a"], "alpha\n\ntwo\n\nthree"),
        (["B", "B1"], "four"),
    ]


def test_reader_registry(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    assert registry.read(spark, str(tmp_path / "a.txt"), hint="csv").first()["text"] == "x\ny"
    try:
        registry.read(spark, "a.docm")
    except ValueError as e:
        assert "parquet" in str(e)
    else:
        raise AssertionError


def _stream(spark, tmp_path, out, mode: str, name: str):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_lifecycle_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i % 7, rng.choice(["view", "click", "purchase", "error"]), i * 60) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    last = _stream(spark, tmp_path, streams.lifecycle(source, "click", "purchase"), "update", "life")
    kind = F.col("event_type")
    batch = tasks.lifecycle(events, "user_id", "event_type", [F.col("ts"), F.col("event_id")], kind == "click", kind == "purchase")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_windows_equal_the_batch(spark, tmp_path):
    rows = [(i, i % 3, "view", i * 500) for i in range(100)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, twin in (("tumble", streams.tumbling_counts), ("session", streams.sessions)):
        got = _stream(spark, tmp_path, twin(source), "complete", name)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin(events).collect()))


def _norm(t: str) -> str:
    t = (t or "").replace("　", " ").replace("\r\n", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def _split(t: str, limit: int) -> list[str]:
    whole = _norm(t)
    if len(whole) <= limit:
        return [whole] if whole else []
    out, held = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[。！？；.!?;])\s+|\n{2,}", whole)):
        if not s:
            continue
        if len(s) > limit:
            out += [held] if held else []
            out += [p for p in (s[i : i + limit].strip() for i in range(0, len(s), limit)) if p]
            held = ""
        elif len(held) + len(s) + 1 <= limit:
            held = f"{held} {s}" if held else s
        else:
            out += [held] if held else []
            held = s
    return out + ([held] if held else [])


def _merge(segments: list[str], least: int, limit: int) -> list[str]:
    out, held = [], ""
    for s in filter(None, map(_norm, segments)):
        if not held:
            held = s
        elif len(held) < least:
            joined = f"{held} {s}"
            if len(joined) > limit:
                out, held = out + _split(joined, limit), ""
            else:
                held = joined
        else:
            out, held = [*out, held], s
    if held and out and len(held) < least:
        out[-1] = f"{out[-1]} {held}"
    elif held:
        out.append(held)
    return [p for s in out for p in (_split(s, limit) if len(s) > limit else [s])]


def test_chunks_equal_a_plain_model(spark):
    texts = [*_texts(), "x" * 9000, " \n\n ".join("short. words" for _ in range(900)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got: dict = {}
    for r in chunks.chunk_documents(docs, "id", "text", 20, 120).orderBy("id", "chunk_order").collect():
        got.setdefault(r["id"], []).append(r["text"])
    for i, t in enumerate(texts):
        whole = _norm(t)
        pieces = [whole[a : a + 4000] for a in range(0, max(len(whole), 1), 4000)]
        assert got.get(i, []) == _merge([s for p in pieces for s in _split(p, 120)], 20, 120), i
