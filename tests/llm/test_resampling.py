"""Importance resampling against its SQL and against a plain version with longer features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillflow.llm import frames, resampling
from tillflow.llm.registry import ORACLES, QUERIES, load

load()

DOCS = "doc_id long, text string, n_words long, buckets string, weight long, rank string, place_ long, part_ long"
TARGET = [(1, "The cat sat on the mat."), (2, None), (3, ""), (None, "the CAT, the dog"), (3, "the cat sat")]


def test_against_sql(spark, folder, con):
    from compare import compare
    assert compare(QUERIES["op12_resampling"](spark, folder), con, ORACLES["op12_resampling"]) is None


def plain(docs, target, longest, buckets, least, percent, seed):
    """Every document's (id, n_features, weight, score) and the drawn ones' order."""
    def features(text):
        w = [x for x in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s = Counter(b for _, t in docs for b in features(t)[1])
    t_ = Counter(b for _, t in target for b in features(t)[1])
    n_s, n_t = sum(s.values()), sum(t_.values())
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t_[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    return rows, [r[:4] for r in fit[:len(fit) * percent // 100]]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_odd_rows_and_longer_features(spark, longest):
    frames.settings(spark)
    rows = [(1, "The cat sat on the mat, the cat!"), (2, None), (3, ""), (None, "no id at all the cat"), (4, " \n\t "),
            (5, "word the cat " * 20_000), (1, "The cat sat on the mat, the cat!"), (6, "x" * 50_000), (7, "é😀 ß\x1c\x85 the 1a"),
            (None, None), *[(100 + i, f"the cat number {i % 7}") for i in range(60)], *[(500, "one of many") for _ in range(90)]]
    docs = spark.createDataFrame([(i, t, 1, "b", 2, "r", 3, 4) for i, t in rows], DOCS)
    target = spark.createDataFrame([(i, t, 9) for i, t in TARGET], "item_id long, text string, buckets long")
    got = resampling.resampled(docs, target, longest=longest, buckets=97, least_words=3, percent=30, keep=("part_",)).collect()
    want, drawn = plain(rows, TARGET, longest, 97, 3, 30, 2024)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in got), key=repr) == sorted(
        (r[:4] for r in want), key=repr)
    ranks = sorted((r.rank, r.doc_id, r.n_features, r.weight, r.score) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranks] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranks] == drawn
    assert {r.part_ for r in got} == {4}


def test_empty_tables(spark):
    frames.settings(spark)
    docs, target = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame(TARGET, "item_id long, text string")
    assert resampling.resampled(docs.limit(0), target).count() == 0
    assert [r.n_features for r in resampling.resampled(docs, target.limit(0)).collect()] == [3]


def test_the_head_holds_exactly_the_frequent(spark):
    frames.settings(spark)
    text = "often seen pair " * 3000 + " ".join(f"rare{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, text), (2, "often " * 5 + "y" * 90 + " " + "seldom " * 2)], "doc_id long, text string")
    head = resampling.head_of(docs, docs.limit(0), longest=2)
    total = 79_000 + 8
    assert total * resampling.HEAD_SHARE > 1 and {"often", "seen", "pair"} <= {w.decode() for w in head.words}
    assert set(head.words) == {b"often", b"seen", b"pair", b"seldom"}
    assert set(head.pairs) == {b"often seen", b"seen pair", b"pair often", b"often often"}
    bare = resampling.Features(2, 10_000)
    words = resampling.words_of(text.encode())[:9100]
    assert head(words) == bare(words)


def test_ranks_of_one_hot_value(spark):
    frames.settings(spark)
    rows = spark.range(3000).select((F.col("id") % 3 * F.lit(0)).alias("score"), F.lit(7).alias("doc_id"))
    got = resampling.ranked(rows.unionAll(spark.createDataFrame([(5, 1)], "score long, doc_id int")), F.desc("score"), F.col("doc_id"))
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3002))
    assert got.where("rank = 1").first().score == 5
