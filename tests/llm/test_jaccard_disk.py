"""The Jaccard join where narrow tables are too large for a broadcast."""

import time

import pytest
from pyspark.sql import functions as F

from gridweave.llm import common, jaccard


@pytest.mark.parametrize("bound", [2, 4])
def test_bounds_of_broadcasts_do_not_matter(spark, monkeypatch, bound):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (0, 1, 59)]
    texts = [" ".join(words), *near, *near, " ".join(words), "a b", "A  b", "", None, " ".join(reversed(words))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, "one id, another text"), (1, "one id, another text"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda: sorted(map(str, jaccard.join(docs).collect()))
    want = of()
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (bound,))
    assert of() == want


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Where more documents share a shingle than may be broadcast, texts are left where they are."""
    line = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"{line} {k}") for k in range(8)], "doc_id long, text string")
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (7,))
    written, of = [], jaccard.checkpoint
    monkeypatch.setattr(jaccard, "checkpoint", lambda df: written.append(df.columns) or of(df))
    got = jaccard.join(docs).collect()
    assert {r["component_id"] for r in got} == {0} and ["id", "text"] not in written


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    spark._jvm.System.gc()
    time.sleep(2)
    before = files()
    common.checkpoint(spark.range(1000).groupBy(F.col("id") % 7).count())
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(common.CLEAN_UP) == "false"
