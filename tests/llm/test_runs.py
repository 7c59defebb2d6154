"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tillflow.llm import frames, runs
from tillflow.llm.registry import QUERIES, load

load()


def plain_runs(w):
    """Every stretch that keeps a period and cannot be prolonged, if the period is its smallest."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_random_words(seed):
    rng, seen = random.Random(seed), 0
    for _ in range(300):
        k = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            # blocks with a period, one into the other
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 20)
            block = [rng.randrange(100, 130) for _ in range(p)]
            w[a:a] = [block[i % p] for i in range(rng.randrange(1, 60))]
        want = plain_runs(w)
        got = runs.runs_of(np.array(w, np.int64)) if len(w) >= runs.LEAST else []
        assert got == want, w
        seen += len(want)
    assert seen > 150


def test_known_words():
    fibonacci, b = [0], [0, 1]
    while len(b) < 300:
        fibonacci, b = b, b + fibonacci
    for w in (b, [0] * 200, [0, 1] * 100, list(range(30)) * 4, list(range(50)), [0] * 11, [0] * 12, list(range(6)) * 2):
        assert runs.runs_of(np.array(w, np.int64)) == plain_runs(w)


def test_long_texts_take_little_time():
    rng = np.random.default_rng(1)
    lines = np.concatenate([np.r_[i, np.arange(90_000, 90_030)] for i in range(5000)])
    for w, most in ((np.zeros(100_000, np.int64), 1), (np.tile(np.arange(20_000), 6), 1), (rng.integers(0, 400, 300_000), 0), (lines, 0)):
        assert len(runs.runs_of(w)) == most


def test_query(spark, folder):
    rows = {r.doc_id: r for r in QUERIES["op13_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    checked = 0
    for d in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", d.text or "") if x]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if n > 1200:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        length, start, period = min(((-r[1], r[0], r[2]) for r in found), default=(None,) * 3)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        assert tuple(rows[d.doc_id]) == (
            d.doc_id, len(found), start, length and -length, period, length and 1000 * -length // period,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(w, found)).encode()).hexdigest())
        checked += bool(found)
    assert checked > 10


def test_odd_rows(spark):
    frames.settings(spark)
    again = "a b c " * 4
    rows = [(1, again), (1, again), (None, again), (2, None), (3, ""), (4, " \n\t "), (5, "é x " * 20), (None, None),
            (6, "one two three"), (7, "w " * 200_000)]
    docs = spark.createDataFrame([(i, t, "r", "c") for i, t in rows], "doc_id long, text string, runs string, collapsed string")
    got = sorted((r.doc_id or 0, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(docs).collect())
    one = ((0, 12, 3),), "a b c"
    assert got == sorted([(1, *one), (1, *one), (0, *one), (2, (), ""), (3, (), ""), (4, (), ""), (5, ((0, 20, 1),), "é x"),
                          (0, (), ""), (6, (), "one two three"), (7, ((0, 200_000, 1),), "w")])
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.planted(None, [b"a"]) == [b"a"] and runs.planted(1, []) == []
