"""Periodic runs of words by maximal pairs.

A stretch of period q is a run exactly where the words q apart agree over some
length l >= q and can be prolonged on neither side. The two places where these
words begin are a maximal pair at distance q: same words over l, other words
before and behind. The pairs come from the LCP-interval tree of the text's
suffixes, taken bottom-up: each interval holds its places in lists by the word
on their left, smaller lists go into larger ones, and a place only meets places
of other lists within the distances that make a run.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import table
from tillflow.llm.registry import query

LEAST = 12  # words of a run
BASE = (LEAST + 1) // 2  # a run of LEAST words or more agrees with itself over so many
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _ranks(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The order of (head, tail); a tail of -1 comes first."""
    key = head * (tail.max() + 2) + tail + 1
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _behind(rank: np.ndarray, step: int) -> np.ndarray:
    """The rank ``step`` words on, -1 behind the end."""
    out = np.full(len(rank), -1, np.int64)
    out[:max(0, len(rank) - step)] = rank[step:]
    return out


def _repeated(ids: np.ndarray) -> np.ndarray:
    """Where BASE words begin that also begin elsewhere in ``ids``."""
    n = len(ids) - BASE + 1
    if n < 2:
        return np.zeros(0, np.int64)
    two = _ranks(ids, _behind(ids, 1))
    four = _ranks(two, _behind(two, 2))
    six = _ranks(four, _behind(two, 4))[:n]
    return np.flatnonzero(np.bincount(six)[six] > 1)


def stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts [lo, hi) of the words such that each run lies in one of them.

    Within a run at most BASE - 1 neighbouring places begin words that the part
    does not repeat. So it is cut where BASE of them follow each other, and again.
    """
    todo = [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        places = _repeated(ids[lo:hi])
        if not len(places):
            continue
        cuts = np.flatnonzero(np.diff(places) > BASE) + 1
        for part in np.split(places, cuts):
            a, b = lo + int(part[0]), lo + int(part[-1]) + BASE
            if b - a >= LEAST:
                if (a, b) == (lo, hi):
                    yield a, b
                else:
                    todo.append((a, b))


def suffixes(ids: np.ndarray) -> tuple[list[int], list[int]]:
    """The suffixes in order, and how many words each shares with the one before it."""
    rank, step, n = ids, 1, len(ids)
    while True:
        rank = _ranks(rank, _behind(rank, step))
        if int(rank.max()) == n - 1:
            break
        step *= 2
    order = np.argsort(rank).tolist()
    words, place, shared, k = ids.tolist(), rank.tolist(), [0] * n, 0
    for i in range(n):
        if place[i] == 0:
            k = 0
            continue
        j = order[place[i] - 1]
        while i + k < n and j + k < n and words[i + k] == words[j + k]:
            k += 1
        shared[place[i]] = k
        k = max(k - 1, 0)
    return order, shared


class Places:
    """The places of an interval, sorted, and in sorted lists by the word to their left."""

    __slots__ = ("every", "by_left")

    def __init__(self, place: int, left: int):
        self.every, self.by_left = [place], {left: [place]}

    def __len__(self):
        return len(self.every)


def _meet(i: int, left: int, other: Places, common: int, lefts: list[int]) -> Iterator[int]:
    """Places of ``other`` behind another word than ``left``, at the distances of a run."""
    near = max(LEAST - common, 1)
    for low, high in ((i - common, i - near), (i + near, i + common)):
        lo, hi = bisect_left(other.every, low), bisect_right(other.every, high)
        if hi - lo <= len(other.by_left):
            for j in other.every[lo:hi]:
                if lefts[j] != left:
                    yield j
        elif hi > lo:
            for word, places in other.by_left.items():
                if word != left:
                    yield from places[bisect_left(places, low):bisect_right(places, high)]


def _merged(a: Places, b: Places) -> Places:
    """The smaller one's places go into the larger one."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) * 8 < len(a):
        for place in b.every:
            insort(a.every, place)
    else:
        a.every = sorted(a.every + b.every)
    for word, places in b.by_left.items():
        held = a.by_left.get(word)
        if held is None:
            a.by_left[word] = places
        elif len(places) * 8 < len(held):
            for place in places:
                insort(held, place)
        else:
            a.by_left[word] = sorted(held + places)
    return a


def maximal_pairs(ids: np.ndarray, before: int) -> Iterator[tuple[int, int, int]]:
    """``(first, distance, common)`` of the maximal pairs that make a run; ``before`` is the word ahead of ``ids``."""
    order, shared = suffixes(ids)
    lefts = [before, *ids[:-1].tolist()]
    # (common words, places) of the open intervals, the deepest last
    open_: list[tuple[int, Places]] = []

    def joined(a: Places, b: Places, common: int):
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        for i in small.every:
            for j in _meet(i, lefts[i], large, common, lefts):
                yield min(i, j), abs(i - j), common

    held = None
    for place, common in zip([*order, None], [*shared, 0]):
        # close the intervals that are deeper than what is shared with the next suffix
        while open_ and open_[-1][0] > common:
            depth, places = open_.pop()
            yield from joined(places, held, depth)
            held = _merged(places, held)
        if place is None:
            break
        if held is not None and common >= BASE:
            if open_ and open_[-1][0] == common:
                depth, places = open_.pop()
                yield from joined(places, held, depth)
                held = _merged(places, held)
            open_.append((common, held))
        held = Places(place, lefts[place])


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of word numbers, by start and period."""
    found: dict[tuple[int, int], int] = {}
    for lo, hi in stretches(ids):
        for first, distance, common in maximal_pairs(ids[lo:hi], int(ids[lo - 1]) if lo else -1):
            run = (lo + first, common + distance)
            # multiples of the period give the same stretch
            found[run] = min(distance, found.get(run, distance))
    return sorted((start, length, period) for (start, length), period in found.items())


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words stand in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones as the same."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words_of: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``(id, runs, collapsed)``: the runs of every row's words, and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` is an array of
    (start, length, period) by start and period; a run has at least 12 words and
    two periods and cannot be prolonged. ``collapsed`` joins by one space the
    words that no run holds behind its first period. ``words_of`` may replace the
    words of a row, given its id and them. Null, empty and blank texts have no
    words: no runs and an empty text. Each row is worked out by itself, so
    repeated rows and ids, null ids and ties give one row each, and an empty
    table none. Extra columns are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("text_"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, runs array<{RUN}>, collapsed binary").schema
    arrow = to_arrow_schema(schema)
    entry = arrow.field("runs").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat, texts = [0], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()  # of bytes: white space of ASCII
                if words_of is not None:
                    words = words_of(i, words)
                found = runs_of(numbered(words)) if len(words) >= LEAST else []
                flat += found
                offsets.append(len(flat))
                if found:
                    out = dropped(found, len(words))
                    words = [w for w, gone in zip(words, out.tolist()) if not gone]
                texts.append(b" ".join(words))
            columns = np.array(flat, np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=list(entry))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), runs.cast(arrow.field("runs").type), pa.array(texts, pa.binary())],
                                             schema=arrow)

    made = rows.mapInArrow(run, schema)
    return made.select(id_col, "runs", F.decode("collapsed", "UTF-8").alias("collapsed"))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document; of one in ten, chosen by id, repeated from some place on. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_runs")
def op13_runs(spark, folder):
    """Every document's runs: how many, the longest, and digests of all and of the text without repeats."""
    found = periodic_runs(table(spark, folder, "documents"), words_of=planted)
    # greatest length, then smallest start and period
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    longest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("r"), F.sha2(
        listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return longest.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), (-F.col("r.less")).alias("length"), F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.less") / F.col("r.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
