"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision of each byte has its own tree of
contexts, the bytes before it. At every node a Krichevsky-Trofimov estimate is
weighed against the product of its children's, so all depths are mixed by what
they gave on the training text. The tree keeps every context that was seen. Its
nodes are rows of Spark tables, one for each depth: weights go up by grouping
nodes by their parents, mixtures come down by joins. So each run of DEPTH + 1
bytes gets its probability; every task holds those of the most frequent runs,
with all others texts are joined.

``tree_counts``, ``weigh`` and ``log10_probabilities`` are the same model in
memory, for small texts, with contexts under ``SHARE`` of the bytes pooled;
``score`` does not use them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import table, texts
from tillflow.llm.registry import query
from tillflow.session import written

DEPTH = 5
SHARE = 2.0 ** -16
FOLDS, HELD_FOLD = 7, 2
END = b"\0"
BLOCK = 1 << 20
# tokens with at least this share of all training tokens go to every task (at most 1 / TOKEN_SHARE), others are joined
TOKEN_SHARE = 2.0 ** -18
DISTINCT = 400_000
END_TOKEN = " "  # no word has a space
# at most so many runs of bytes go to every task with their probabilities, the most frequent ones
FREQUENT = 1 << 20


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(True))


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _padded_blocks(parts: list[bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Texts with their end, each behind DEPTH zero bytes, in blocks; long ones are cut.

    Yields the bytes and the lengths of the texts' pieces: a piece begins DEPTH
    bytes behind the end of the piece before it. Lengths of pieces that go on
    in the next block are negative.
    """
    rows, lengths, size = [], [], 0
    for data in parts:
        whole = bytes(DEPTH) + data + END
        for at in range(0, len(whole) - DEPTH, BLOCK):
            piece = whole[at:at + BLOCK + DEPTH]
            last = at + BLOCK + DEPTH >= len(whole)
            rows.append(piece)
            lengths.append((len(piece) - DEPTH) * (1 if last else -1))
            size += len(piece)
            if size >= BLOCK:
                yield np.frombuffer(b"".join(rows), np.uint8), lengths
                rows, lengths, size = [], [], 0
    if rows:
        yield np.frombuffer(b"".join(rows), np.uint8), lengths


def _scored_places(lengths: list[int]) -> np.ndarray:
    """Where in a block the bytes stand that have all their DEPTH bytes of context."""
    sizes = np.abs(np.array(lengths, np.int64)) + DEPTH
    mask = np.ones(sizes.sum(), bool)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for j in range(DEPTH):
        mask[starts + j] = False
    return np.flatnonzero(mask)


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of DEPTH + 1 bytes that end at the given places, as whole numbers; the last byte is the lowest."""
    code = np.zeros(len(at), np.int64)
    for d in range(DEPTH, -1, -1):
        code = (code << 8) | data[at - d]
    return code


def gram_counts(docs: DataFrame, trains: Column | None = None) -> DataFrame:
    """``(code, n)``: how often each run of DEPTH + 1 bytes occurs in the training text, combined within tasks.

    Runs that only rows without ``trains`` have are there with n = 0.
    """
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def merged(chunks: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(chunks).group_by("code").aggregate([("n", "sum")]).rename_columns(["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, rows = [], 0
        for batch in batches:
            blocks = [(block, times) for times in (1, 0) for block in _padded_blocks(
                [_lowered(t) for t in batch.column(0).filter(pc.equal(batch.column(1), times)).to_pylist()])]
            for (data, lengths), times in blocks:
                counted = pc.value_counts(pa.array(_codes(data, _scored_places(lengths))))
                chunks.append(pa.table({"code": counted.field(0), "n": pc.multiply(counted.field(1), times)}))
                rows += len(counted)
                if rows > 2_000_000:
                    chunks = [merged(chunks)]
                    rows = chunks[0].num_rows
                    if rows > 1_000_000:
                        yield from chunks[0].cast(schema).to_batches(100_000)
                        chunks, rows = [], 0
        if chunks:
            yield from merged(chunks).cast(schema).to_batches(100_000)

    trains = F.lit(1) if trains is None else trains.cast("int")
    return docs.select("text", trains.alias("times")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """log gamma(x), x > 0: Stirling's series of x + 6 and the six factors between."""
    y = x + 6
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _prefix(d: int) -> Column:
    """The key of a node's ancestor at depth ``d``."""
    return F.col("key").bitwiseAND((1 << (8 * d + 8)) - 1)


def gram_values(grams: DataFrame) -> DataFrame:
    """``(code, n, value)``: log10 of the probability of a run's last byte after its first DEPTH.

    All runs of ``grams`` are there, and for each the one with the other last
    bit. A node is a decision (1 to 255 in heap order) of a context; its key is
    the context's code with the decision in the lowest byte. Nodes that only
    runs with n = 0 have change nothing: their estimates and weights are log 1,
    and their decisions come out as one half at their depth.
    """
    def decision(j: int):
        byte = F.col("code").bitwiseAND(255)
        return F.struct((F.col("code") - byte).bitwiseOR(F.shiftright(byte + 256, 8 - j)).alias("key"),
                        F.shiftright(byte, 7 - j).bitwiseAND(1).alias("bit"))

    def own(level: DataFrame) -> DataFrame:
        ones, zeros = F.col("ones").cast("double"), (F.col("every") - F.col("ones")).cast("double")
        value = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)
        # exactly 0 where nothing was counted
        return level.withColumn("own", F.when(F.col("every") == 0, 0.0).otherwise(value))

    # bottom-up: a node's own estimate, and the product of its children's weights
    nodes = grams.select(F.explode(F.array(*[decision(j) for j in range(8)])).alias("d"), "n")
    nodes = nodes.groupBy(F.col("d.key").alias("key")).agg(F.sum(F.col("n") * F.col("d.bit")).alias("ones"), F.sum("n").alias("every"))
    levels = {DEPTH: written(own(nodes), f"depth{DEPTH}")}
    weight = F.col("own")
    for d in range(DEPTH - 1, -1, -1):
        above = levels[d + 1].withColumn("weight", weight).groupBy(_prefix(d).alias("key")).agg(
            F.sum("ones").alias("ones"), F.sum("every").alias("every"), F.sum("weight").alias("below"))
        levels[d] = written(own(above), f"depth{d}")
        weight = (F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2))

    # top-down: what the nodes above add to each decision, and the share left to those below
    one = (F.col("ones") + 0.5) / (F.col("every") + 1)
    mixed = levels[0].withColumns({"added": F.lit(0.0), "left": F.lit(1.0)})
    for d in range(DEPTH):
        share = 1 / (1 + F.exp(F.col("below") - F.col("own")))
        mixed = mixed.select(F.col("key").alias("parent"), (F.col("added") + F.col("left") * share * one).alias("added"),
                             (F.col("left") * (1 - share)).alias("left"))
        mixed = levels[d + 1].join(mixed, _prefix(d) == F.col("parent")).drop("parent")
    leaves = mixed.select(F.shiftright("key", 8).alias("context"), F.struct(
        F.col("key").bitwiseAND(255).alias("node"), "ones", "every", (F.col("added") + F.col("left") * one).alias("one")).alias("d"))
    # bounded: a context has 255 decisions at most
    contexts = leaves.groupBy("context").agg(F.collect_list("d").alias("decisions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            node, ones, every, one = (x.to_numpy() for x in lists.flatten().flatten())
            at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            p_one = np.full((len(lists), 256), 0.5)
            p_one[at, node] = one
            values = _byte_logs(p_one, np.float64)
            last = node >= 128
            at, byte = at[last], 2 * node[last] - 256
            context = batch.column(0).to_numpy()[at] << 8
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((context | byte, context | byte | 1))),
                pa.array(np.concatenate((every[last] - ones[last], ones[last]))),
                pa.array(np.concatenate((values[at, byte], values[at, byte + 1])))], names=["code", "n", "value"])

    return contexts.mapInArrow(run, "code long, n long, value double")


class Frequent:
    """The values of some runs, the most frequent ones found first."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, values: np.ndarray):
        order = np.lexsort((codes, -counts))
        self.codes, self.values = np.append(codes[order], -1), np.append(values[order], 0.0)
        self.bits = max(8, len(codes).bit_length() + 2)
        self.slots = np.full(1 << self.bits, len(codes), np.int32)
        slot = self._slot(self.codes[:-1])
        self.slots[slot[::-1]] = np.arange(len(codes) - 1, -1, -1, dtype=np.int32)  # the first of a slot stays
        behind = np.flatnonzero(self.slots[slot] != np.arange(len(codes)))
        behind = behind[np.argsort(self.codes[behind])]
        self.more, self.more_values = np.append(self.codes[behind], 1 << 62), np.append(self.values[behind], 0.0)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each run's value, 0 if it has none here; and the places of those that have none."""
        index = self.slots.take(self._slot(codes))
        values = self.values.take(index)
        others = np.flatnonzero(self.codes.take(index) != codes)
        at = np.searchsorted(self.more, codes[others])
        known = self.more[at] == codes[others]
        values[others] = np.where(known, self.more_values[at], 0.0)
        return values, others[~known]


def frequent_values(values: DataFrame) -> tuple[Frequent, Column]:
    """Up to FREQUENT of the most frequent runs of the training text, and the condition that others meet."""
    size = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8)
    sizes = values.where("n > 0").groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()  # 512 rows at most
    least, held = 1 << 10, 0
    for r in sizes:
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["size"]
    chosen = (F.col("n") > 0) & (size >= least)
    rows = values.where(chosen).toArrow()  # bounded: FREQUENT rows
    return Frequent(*(rows.column(k).to_numpy() for k in ("code", "n", "value"))), ~chosen


def known_values(batch: list[bytes], frequent: Frequent) -> tuple[list[float], pa.ListArray, pa.ListArray]:
    """For each text the sum of its frequent runs' values, and its other runs and how often it has them."""
    sums, at_text, others = np.zeros(len(batch)), [], []
    text = 0
    for data, lengths in _padded_blocks(batch):
        codes = _codes(data, _scored_places(lengths))
        values, missing = frequent.find(codes)
        sizes = np.array(lengths)
        starts = np.concatenate(([0], np.cumsum(np.abs(sizes))[:-1]))
        own = text + np.concatenate(([0], np.cumsum(sizes > 0)[:-1]))  # a piece that goes on has the text of the next one
        np.add.at(sums, own, np.add.reduceat(values, starts))
        at_text.append(own[np.searchsorted(starts, missing, "right") - 1])
        others.append(codes[missing])
        text += int((sizes > 0).sum())
    at, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at_text, others))
    order = np.lexsort((code, at))
    at, code = at[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (code[1:] != code[:-1])))[:len(at)])
    times = np.diff(np.append(first, len(at)))
    offsets = pa.array(np.searchsorted(at[first], np.arange(len(batch) + 1)).astype(np.int32))
    return (sums.tolist(), pa.ListArray.from_arrays(offsets, pa.array(code[first])),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))))


def token_counts(train: DataFrame) -> DataFrame:
    """``(token, n)`` of the training text's words and ends, combined within tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in counts], pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_lowered(text).split())
                counts[END_TOKEN.encode()] += 1
                if len(counts) > DISTINCT:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return train.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def tree_counts(grams: DataFrame) -> tuple[list[dict], int]:
    """For each depth the kept contexts' codes and their 256 counts; and the number of training bytes."""
    contexts = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("code", 8).bitwiseAND((1 << (8 * d)) - 1).alias("context"))
                         for d in range(DEPTH + 1)])
    each = grams.select(F.explode(contexts).alias("c"), F.col("code").bitwiseAND(255).alias("byte"), "n")
    pairs = written(each.groupBy("c.depth", "c.context", "byte").agg(F.sum("n").alias("n")), "pairs")
    total = pairs.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    kept = pairs.groupBy("depth", "context").agg(F.sum("n").alias("all")).where(F.col("all") >= max(1.0, SHARE * total))
    # bounded: at most 1 / SHARE contexts a depth and 256 bytes behind each
    rows = pairs.join(kept.select("depth", "context"), ["depth", "context"], "left_semi").toArrow()
    depth, context, byte, n = (rows.column(k).to_numpy() for k in ("depth", "context", "byte", "n"))
    levels = []
    for d in range(DEPTH + 1):
        here = depth == d
        codes, at = np.unique(context[here], return_inverse=True)
        counts = np.zeros((len(codes), 256))
        counts[at, byte[here]] = n[here]
        levels.append({"codes": codes, "counts": counts})
    return levels, total


def _zeros_and_ones(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the next byte -> for the 256 binary decisions (1 to 255 in heap order) how often 0 and 1."""
    zeros, ones = np.zeros_like(counts), np.zeros_like(counts)
    sums = counts
    for bit in range(8):  # the last bit first
        sums = sums.reshape(len(counts), 128 >> bit, 2)
        width = sums.shape[1]
        zeros[:, width:2 * width], ones[:, width:2 * width] = sums[:, :, 0], sums[:, :, 1]
        sums = sums.sum(axis=2)
    return zeros, ones


_TABLE = 1 << 16
_LOG_GAMMA = np.array([math.lgamma(k + 0.5) for k in range(_TABLE)])
_LOG_FACTORIAL = np.array([math.lgamma(k + 1.0) for k in range(_TABLE)])


def _gamma(k: np.ndarray, values: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(k + shift) of whole numbers: from the table, beyond it by Stirling's series."""
    x = np.maximum(k, _TABLE) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(k < _TABLE, values[np.minimum(k, _TABLE - 1).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return (_gamma(zeros, _LOG_GAMMA, 0.5) + _gamma(ones, _LOG_GAMMA, 0.5)
            - _gamma(zeros + ones, _LOG_FACTORIAL, 1.0) - math.log(math.pi))


def weigh(levels: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Tables that score a byte: ``child`` (inner node, older byte) and ``logs`` (leaf, byte).

    An entry of ``child`` is an inner node, or -1 - leaf. The root is inner
    node 0, or leaf 0 if the table has no rows. A context's inner node appears
    if some longer context is kept; its pooled child is a leaf. Log10.
    """
    # bottom-up: weighted probabilities; inner nodes are those with kept children
    for d in range(DEPTH, -1, -1):
        level = levels[d]
        level["pooled"] = level["counts"]
        level["inner"] = np.zeros(len(level["codes"]), bool)
        zeros, ones = _zeros_and_ones(level["counts"])
        level["kt"] = ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
        own = log_kt(zeros, ones)
        level["weighted"] = own
        if d < DEPTH and len(levels[d + 1]["codes"]):
            below = levels[d + 1]
            parent = np.searchsorted(level["codes"], below["codes"] & ((1 << (8 * d)) - 1))
            below["parent"] = parent
            level["inner"][parent] = True
            rest = level["counts"].copy()
            np.subtract.at(rest, parent, below["counts"])
            product = log_kt(*_zeros_and_ones(rest))
            np.add.at(product, parent, below["weighted"])
            mixed = np.logaddexp(own, product) - math.log(2)
            # how much the node's own estimate counts against its children's
            level["own"] = np.where(level["inner"][:, None], 1 / (1 + np.exp(np.clip(product - own, -700, 700))), 1.0)
            level["weighted"] = np.where(level["inner"][:, None], mixed, own)
            level["pooled"] = rest
            del below["weighted"], below["counts"]
        level.setdefault("own", np.ones_like(own))
        level["own"] = level["own"].astype(np.float32)
    # top-down: what the nodes above add to each decision, and the share left to those below
    inner_at, logs, children = 0, [], []
    for d, level in enumerate(levels):
        n = len(level["codes"])
        if d == 0:
            level["sum"], level["left"] = np.zeros((n, 256), np.float32), np.ones((n, 256), np.float32)
        level["id"] = np.zeros(n, np.int64)
        inner = np.flatnonzero(level["inner"])
        level["id"][inner] = inner_at + np.arange(len(inner))
        inner_at += len(inner)
        leaves = np.flatnonzero(~level["inner"])
        leaf_at = sum(map(len, logs))
        level["id"][leaves] = -1 - (leaf_at + np.arange(len(leaves)))
        logs.append(_byte_logs(level["sum"][leaves] + level["left"][leaves] * level["kt"][leaves]))
        if d and n:
            above, parent = levels[d - 1], level["parent"]
            byte = (level["codes"] >> (8 * (d - 1))) & 255
            children[d - 1][above["id"][parent], byte] = level["id"]
        # a row of children for each inner node, at first all the pooled leaf
        level["sum"] = level["sum"] + level["left"] * level["own"] * level["kt"]
        level["left"] = level["left"] * (1 - level["own"])
        leaf_at = sum(map(len, logs))
        if len(inner):
            zeros, ones = _zeros_and_ones(level["pooled"][inner])
            logs.append(_byte_logs(level["sum"][inner] + level["left"][inner] * (ones + 0.5) / (zeros + ones + 1)))
        rows = np.empty((inner_at, 256), np.int32)
        rows[level["id"][inner]] = (-1 - (leaf_at + np.arange(len(inner))))[:, None]
        children.append(rows)
        if d < DEPTH and len(levels[d + 1]["codes"]):
            parent = levels[d + 1]["parent"]
            levels[d + 1]["sum"], levels[d + 1]["left"] = level["sum"][parent], level["left"][parent]
        elif d < DEPTH:
            levels[d + 1]["sum"] = levels[d + 1]["left"] = np.zeros((0, 256), np.float32)
    child, done = np.empty((inner_at, 256), np.int32), 0
    for rows in children:
        child[done:len(rows)] = rows[done:]
        done = len(rows)
    if not logs or not sum(map(len, logs)):
        logs = [np.full((1, 256), -8 * math.log10(2), np.float32)]  # nothing learned: every bit one half
    return child, np.concatenate(logs)


def _byte_logs(p_one: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """log10 of each byte's probability from those of a 1 in the 256 decisions."""
    with np.errstate(divide="ignore"):
        one, zero = np.log10(p_one), np.log10(1 - p_one)
    out = np.zeros((len(p_one), 256), kind)
    byte = np.arange(256)
    for bit in range(7, -1, -1):
        node = (256 + byte) >> (bit + 1)
        out += np.where((byte >> bit) & 1, one[:, node], zero[:, node])
    return out


def log10_probabilities(batch: list[bytes], child: np.ndarray, logs: np.ndarray) -> list[float]:
    """log10 of each text's probability, its end included."""
    out, carried = [], 0.0
    flat_child, flat_logs = child.ravel(), logs.ravel()
    for data, lengths in _padded_blocks(batch):
        at = _scored_places(lengths)
        node = np.zeros(len(at), np.int32) if len(child) else np.full(len(at), -1, np.int32)
        for d in range(1, DEPTH + 1):
            step = flat_child.take(np.maximum(node, 0) * 256 + data[at - d]) if len(child) else node
            node = np.where(node >= 0, step, node)
        values = flat_logs.take((-1 - node).astype(np.int64) * 256 + data[at]).astype(np.float64)
        sizes = np.abs(np.array(lengths))
        sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(sizes)[:-1])))
        for length, value in zip(lengths, sums.tolist()):
            carried += value
            if length > 0:
                out.append(carried)
                carried = 0.0
    return out


def score(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Learns from the rows whose ids are not in the held-out fold; null ids are
    held out. Null texts count as empty: one token, the end. Repeated rows
    count as often as they stand there and give one row each. With no training
    rows every bit has probability one half and N and V are 0. An empty table
    gives no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    whole = texts(docs, id_col)
    train = whole.where(~held_out(id_col)).select("text")
    values = written(gram_values(gram_counts(whole, ~held_out(id_col))), "values")
    frequent_runs, other_runs = frequent_values(values)
    shared = spark.sparkContext.broadcast(frequent_runs)

    counts = written(token_counts(train), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = F.col("n") >= max(1.0, TOKEN_SHARE * total)
    # bounded: at most 1 / TOKEN_SHARE tokens are this frequent
    known = spark.sparkContext.broadcast({r.token.encode("utf-8", "surrogatepass"): math.log10(r.n + 1)
                                          for r in counts.where(frequent).toLocalIterator()})
    per_token = math.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        find, runs = known.value.get, shared.value
        end = find(END_TOKEN.encode())
        for batch in batches:
            parts = [_lowered(t) for t in batch.column(2).to_pylist()]
            made = {"row": [], "n_tokens": [], "n_frequent": [], "base": [], "tokens": [], "times": []}
            for data in parts:
                words = data.split()
                found = [find(w) for w in words]
                rare = Counter(w for w, f in zip(words, found) if f is None)
                made["row"].append(row)
                row += 1
                made["n_tokens"].append(len(words) + 1)
                made["n_frequent"].append(len(words) - rare.total() + (end is not None))
                made["base"].append(math.fsum(f for f in found if f is not None) + (end or 0.0)
                                    - (len(words) + 1) * per_token)
                made["tokens"].append([w.decode("utf-8", "replace") for w in rare])
                made["times"].append(list(rare.values()))
            sums, codes, code_times = known_values(parts, runs)
            columns = [pa.array(made["row"], pa.int64()), batch.column(0), batch.column(1),
                       pa.array(made["n_tokens"], pa.int64()), pa.array(made["n_frequent"], pa.int64()),
                       pa.array(made["base"], pa.float64()),
                       pa.array(sums, pa.float64()),
                       pa.array(made["tokens"], pa.list_(pa.string())), pa.array(made["times"], pa.list_(pa.int64())),
                       codes, code_times]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["row", id_col, "held_out", "n_tokens", "n_frequent", "base", "known_score", "tokens", "times", "codes", "code_times"]
    kind = docs.schema[id_col].dataType.simpleString()
    scored = written(whole.select(id_col, held_out(id_col).alias("held_out"), "text").mapInArrow(
        run, f"row long, `{id_col}` {kind}, held_out boolean, n_tokens long, n_frequent long, base double, "
             "known_score double, tokens array<string>, times array<long>, codes array<long>, code_times array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select(
        "row", F.col("t.tokens").alias("token"), F.col("t.times").alias("times"))
    rare = rare.join(counts.where(~frequent), "token").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"))
    others = scored.select("row", F.explode(F.arrays_zip("codes", "code_times")).alias("c")).select(
        "row", F.col("c.codes").alias("code"), F.col("c.code_times").alias("code_times"))
    others = others.join(values.where(other_runs).select("code", "value"), "code").groupBy("row").agg(
        F.sum(F.col("code_times") * F.col("value")).alias("other_score"))
    return scored.join(rare, "row", "left").join(others, "row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"),
        (F.col("known_score") + F.coalesce("other_score", F.lit(0.0))).alias("score"))


@query("op8_context_tree")
def op8_context_tree(spark, folder):
    """Every document's log10 probability under the model of the training documents."""
    return score(table(spark, folder, "documents"))
