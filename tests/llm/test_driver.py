"""What operators leave on the driver: free native memory, and records of jobs."""

import random
import re
import time
import uuid
from pathlib import Path

import pytest

from quillspark.llm import perplexity
from quillspark.llm.common import release, trim_native
from quillspark.llm.components import components

#: Before discounts were counted in one pass, and rounds of components had fewer exchanges: 59 and 23.
JOBS_MODEL, JOBS_COMPONENTS = 48, 20


def resident_mb(pid: int) -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def test_release_gives_native_memory_back(spark):
    if not Path("/proc/self/status").exists() or not trim_native(spark):
        pytest.skip("this JVM has no command to trim native memory")
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(1500)]
    full = resident_mb(pid)
    held = held[::50]  # a few stay in between and at the end, so the C library can't shrink its heap by itself
    for _ in range(3):
        release(spark)
        time.sleep(0.5)  # buffers are freed by a thread of their own
    assert len(held) == 30
    assert resident_mb(pid) < full - 100


def jobs(spark, run) -> int:
    """Jobs that a call starts; with adaptive execution every exchange is one."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setJobGroup(uuid.uuid4().hex, "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_few_jobs_for_a_model(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("abcdef ") for _ in range(200)), i % 2) for i in range(20)]
    texts = spark.createDataFrame(rows, "text string, half int").cache()
    texts.count()
    n = jobs(spark, lambda: perplexity.levels(texts))
    assert n <= JOBS_MODEL


def test_few_jobs_for_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 4)], "a long, b long").cache()
    links.count()
    got = []
    n = jobs(spark, lambda: got.extend(components(links).collect()))
    assert {r["id"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert n <= JOBS_COMPONENTS
