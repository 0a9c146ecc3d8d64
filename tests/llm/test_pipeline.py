"""The pipeline against brute force on a small corpus."""

import random
import re
from collections import Counter

import pytest

from tests.llm.fixtures import prose
from tests.llm.test_pairs import sets_of, smallest_reachable

pipeline = pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(30, 120)).capitalize() + "." for _ in range(160)]
    texts += [" ".join(w.upper() + "!!%" for w in prose(rng, 50).split()) for _ in range(10)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:20]]
    texts += [" ".join("odd" if i == 11 else w for i, w in enumerate(t.split())) for t in texts[20:50]]
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, 0), (901, "", "en", "s1", 0)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 150)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return root, rows


def test_stages(spark, corpus):
    root, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    by = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    all_docs = by(docs)
    kept = pipeline.quality(spark, docs, root)
    assert kept.columns == docs.columns
    good = by(kept)
    assert not any(i in good for i in range(160, 170)) and sum(i in good for i in range(160)) >= 157
    single = by(pipeline.exact_copies(spark, docs, root))
    first: dict = {}
    for i, t in sorted(all_docs.items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    assert set(single) == set(first.values())
    components = smallest_reachable(sets_of(list(all_docs.items())))
    assert set(by(pipeline.near_copies(spark, docs, root))) == {i for i, c in components.items() if i == c}
    mixed = pipeline.mixture(spark, docs, root)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2


def test_run_is_its_stages(spark, corpus):
    root, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        folder = f"{root}/check-{k}"
        stage(spark, docs, root).write.parquet(folder)
        docs = spark.read.parquet(folder)
    library = sentencepiece.SentencePieceProcessor(model_file=pipeline.tokenizer_path())
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in docs.collect())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in pipeline.run(spark, root).collect())
    assert got == want and len(got) > 50


def test_run_goes_on_where_it_stopped(spark, corpus, tmp_path, monkeypatch):
    root, _ = corpus
    folder = str(tmp_path / "run")
    first = Counter(r["doc_id"] for r in pipeline.run(spark, root, folder).collect())

    def never(*_):
        raise AssertionError("a finished stage ran again")

    stages = [(n, never) for n, _ in pipeline.STAGES[:3]] + pipeline.STAGES[3:]
    monkeypatch.setattr(pipeline, "STAGES", stages)
    spark.read.parquet(f"{folder}/mixture").limit(0).write.parquet(f"{folder}/unfinished")
    import shutil

    shutil.rmtree(f"{folder}/mixture-done")
    assert Counter(r["doc_id"] for r in pipeline.run(spark, root, folder).collect()) == first
