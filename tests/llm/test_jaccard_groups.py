"""Large groups of near copies in the Jaccard join, of which many link with none."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.llm import jaccard


def group_of(rng, size, edits, words=140):
    base, texts = [f"w{k}" for k in range(words)], []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.choice(edits)):
            copy[rng.randrange(words)] = f"n{rng.random()}"
        texts.append(" ".join(copy))
    return texts


def sets_of(texts, width):
    return [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in map(str.split, texts)]


def linked(sets, percent):
    return [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def roots(pairs, n):
    root = list(range(n))
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    return root


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_rows_dealt_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard, "REGION", 45)
    dealt, cut = [], jaccard._cut

    def counted(*args):
        out = cut(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_cut", counted)
    texts = group_of(random.Random(5), 240, [0, 1, 1, 2, 7, 8, 9, 10])
    root = roots(linked(sets_of(texts, width), percent), len(texts))
    assert 50 < len(set(root)) < 200
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs_of(spark, texts), width, percent).collect()}
    assert got == dict(enumerate(root))
    assert max(dealt, default=0) <= 2 * len(texts)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
def test_what_links_stays_in_a_common_region(spark, width, percent):
    rng = random.Random(percent)
    texts = [t for words in (10, 40, 90) for t in group_of(rng, 40, [0, 1, 2, 3], words)]
    texts += [" ".join(t.split()[: rng.randint(8, 90)]) for t in texts[-40:]]
    docs = docs_of(spark, texts).withColumnRenamed("doc_id", "id")
    of = [rng.randrange(6) for _ in texts]  # components as they may be known before
    members = spark.createDataFrame(list(enumerate(of)), "id long, component long")
    placed = jaccard.by_exact_counts(members, docs, width, percent)
    assert {r["id"]: r["n"] for r in placed.collect()}.items() <= dict(enumerate(map(len, sets_of(texts, width)))).items()
    rows = placed.collect()
    can = {(x["region"], x["id"]) for x in rows for y in rows if x["region"] == y["region"] and x["component"] != y["component"] and (100 + percent) * min(x["rest"], y["rest"]) >= percent * (x["n"] + y["n"])}
    stay = {(r["region"], r["id"]) for r in jaccard.able(placed, percent).collect()}
    assert stay == can and len(can) < len(rows)
    regions = {}
    for region, k in stay:
        regions.setdefault(k, set()).add(region)
    pairs = [(i, j) for i, j in linked(sets_of(texts, width), percent) if of[i] != of[j]]
    assert pairs and all(regions[i] & regions[j] for i, j in pairs)


def test_sets_of_one_id_are_apart(spark):
    texts = group_of(random.Random(2), 3, [1], 30)
    docs = spark.createDataFrame([(1, texts[0]), (1, "a b c d"), (2, texts[1]), (3, "a b c d"), (4, None)], "id long, text string")
    members = docs.select("id", F.col("id").alias("component")).distinct()
    got = {(r["id"], r["n"]) for r in jaccard.by_exact_counts(members, docs, 3, 60).collect()}
    assert got == {(1, 28), (1, 2), (2, 28), (3, 2)}
