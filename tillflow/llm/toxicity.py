"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary windows, one on the
words of toxic text that begin like no others do; trained on whole toxic
windows it would mostly hold ordinary words. A window's gain is how many bytes
shorter it is compressed with both together than with the ordinary one and as
many zero bytes. The document's gains become a score by thresholds calibrated
(logistic regression) on the labelled sample.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import map_texts, table, texts
from tillflow.llm.registry import query

# the labelled sample: at most so many documents of each label, each of at most so many bytes
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 3000, 1 << 15
FOLDS, HELD_FOLD = 5, 0
WINDOW = 64
SAMPLE_WINDOWS = 40_000  # of the sample, evenly spread, for the dictionary trainer
# a word's beginning marks toxic text if so large a share of toxic documents has it, so many times the share of others
LEAST_SHARE, LEAST_COUNT, LEAST_RATIO, LONGEST = 0.01, 3, 25, 14
SHARED_BYTES, TOXIC_BYTES, MISTAKEN_BYTES = 8000, 8000, 12000
SEGMENTS = (16, 24)  # lengths of the pieces that the toxic dictionary is put together from


# ASCII other than letters and digits separates words
SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _normal(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().translate(SPACED).split()) + b" "


def windows(data: bytes, width: int = WINDOW) -> list[bytes]:
    """Consecutive windows, cut at white space where there is some; never empty."""
    out, at = [], 0
    while at < len(data) - 1:
        end = at + width
        if end < len(data):
            space = data.find(b" ", end, end + width)
            end = space if space >= 0 else end + width
        out.append(data[at:end + 1])
        at = end
    return out or [b" "]


def _codes(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(x) < n:
        return np.zeros(0, np.uint64)
    k = np.zeros(len(x) - n + 1, np.uint64)
    for j in range(n):
        k = k * np.uint64(0x100000001B3 if n > 8 else 256) + x[j:len(x) - n + 1 + j]
    return k


def _without_copies(docs: list[bytes]) -> list[bytes]:
    """Leaves out documents a fifth of whose sampled 16-byte strings were met before."""
    met, out = set(), []
    for data in docs:
        k = (_codes(data, 16) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        k = set(k[k % np.uint64(8) == 0].tolist())
        if not k or len(k & met) <= 0.2 * len(k):
            out.append(data)
            met |= k
    return out


def _beginnings(data: bytes) -> set[bytes]:
    """The words of a text and their beginnings, from four bytes on."""
    return {w[:k] for w in set(data.split()) for k in range(4, min(len(w), LONGEST) + 1)}


def toxic_strings(toxic: list[bytes], clean: list[bytes]) -> list[bytes]:
    """The longest beginnings of words that mark toxic text, the most frequent last."""
    in_toxic, in_clean = Counter(), Counter()
    for docs, counts in ((toxic, in_toxic), (clean, in_clean)):
        for data in docs:
            counts.update(_beginnings(data))
    least = max(LEAST_COUNT, LEAST_SHARE * len(toxic))
    marks = {w: n for w, n in in_toxic.items() if n >= least
             and n / len(toxic) >= LEAST_RATIO * (in_clean[w] + 0.5) / max(1, len(clean))}
    # a beginning that nearly always goes on in the same way is left to the longer one
    longer = Counter()
    for w, n in marks.items():
        if w[:-1] in marks:
            longer[w[:-1]] = max(longer[w[:-1]], n)
    return sorted((w for w, n in marks.items() if longer[w] < 0.9 * n), key=lambda w: (marks[w], w))


class Model:
    """The two dictionaries and the weights; pickled into the tasks."""

    def __init__(self, shared: bytes, toxic: bytes):
        self.shared, self.toxic, self.scale = shared, toxic, None

    @cached_property
    def compressors(self):
        def make(tail: bytes):
            kind = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=6, target_length=16,
                strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
            own = zstandard.ZstdCompressionDict(self.shared + tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=kind)
            return zstandard.ZstdCompressor(dict_data=own, compression_params=kind).compress
        return make(bytes(len(self.toxic))), make(self.toxic)

    def features(self, data: bytes) -> list[float]:
        ordinary, toxic = self.compressors
        gains = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(data)])
        n, best = len(gains), np.zeros(3)
        top = np.sort(np.maximum(gains, 0))[::-1][:3]
        best[:len(top)] = top
        return [*best, (gains >= 3).sum() / np.sqrt(n), (gains >= 4).sum() / np.sqrt(n),
                (gains >= 5).sum() / np.sqrt(n), np.maximum(gains - 1, 0).sum() / n, np.log(n)]

    def __getstate__(self):
        """Without the compressors, which each task makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def calibrate(self, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> None:
        mean, spread = features.mean(0), features.std(0) + 1e-9
        a = np.c_[np.ones(len(features)), (features - mean) / spread]
        w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
        penalty[0, 0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - labels) + penalty @ w)
        self.scale = mean, spread, w

    def judge(self, features: np.ndarray) -> np.ndarray:
        mean, spread, w = self.scale
        return 1 / (1 + np.exp(-np.clip(w[0] + ((features - mean) / spread) @ w[1:], -30, 30)))

    def score(self, text: str) -> float:
        if self.scale is None:  # nothing toxic was ever labelled
            return 0.0
        return float(self.judge(np.array(self.features(_normal(text)))))


def excerpts(docs: list[bytes], marks: list[bytes]) -> list[bytes]:
    """Every word that begins with a mark, as often as it comes: what the toxic dictionary is trained on."""
    starts = frozenset(marks)
    lengths = sorted({len(w) for w in starts}, reverse=True)
    return [b" " + w + b" " for d in docs for w in d.split() if any(w[:n] in starts for n in lengths)]


def dictionary(samples: list[bytes], size: int, segment: int | None = None) -> bytes:
    """Content of a dictionary trained on ``samples``, from segments of the given length."""
    tuned = {} if segment is None else {"k": segment, "d": 6}
    try:
        # the trainer wants eight bytes at least
        return zstandard.train_dictionary(size, [w.ljust(8) for w in samples], level=3, **tuned).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:]


def build(toxic: list[bytes], clean: list[bytes]) -> Model:
    """Dictionaries and weights from normalized toxic and ordinary texts."""
    samples = [w for d in clean for w in windows(d)]
    samples = samples[::len(samples) // SAMPLE_WINDOWS + 1]
    shared = dictionary(samples, 1 << 14)[-SHARED_BYTES:]
    marks = toxic_strings(toxic, clean) if toxic else []
    if not (toxic and clean and marks):
        return Model(shared, b"")
    found = excerpts(toxic, marks)
    labels = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    best = None

    def tried(one: Model) -> None:
        # a test on halves decides
        nonlocal best
        features = np.array([one.features(d) for d in [*toxic, *clean]])
        loss, half = 0.0, np.arange(len(labels)) % 2 == 0
        for side in (half, ~half):
            one.calibrate(features[side], labels[side])
            p = np.clip(one.judge(features[~side]), 1e-4, 1 - 1e-4)
            loss -= np.log(np.where(labels[~side] == 1, p, 1 - p)).sum()
        one.calibrate(features, labels)
        if best is None or loss < best[0]:
            best = loss, one

    for segment in SEGMENTS:
        tried(Model(shared, dictionary(found, TOXIC_BYTES, segment)))
    # clean windows that the pair takes for toxic may join the ordinary text of both
    ordinary, toxic_too = best[1].compressors
    mistaken = dict.fromkeys(w for w in samples if len(ordinary(w)) > len(toxic_too(w)) + 1)
    tried(Model(b"".join(mistaken)[:MISTAKEN_BYTES] + shared, best[1].toxic))
    return best[1]


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """Learns from labelled documents outside the held-out fold, those whose ids have the smallest hashes."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(id_col) != HELD_FOLD)).groupBy(id_col).agg(
        F.max("toxic").alias("toxic"))
    # lengths first, so that long texts leave no gap in the sample; only ids are shuffled
    fits = F.octet_length("text") <= SAMPLE_BYTES
    known = known.join(texts(docs, id_col).where(fits).select(id_col).distinct(), id_col, "left_semi")
    text = {}
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        # bounded: at most ``most`` ids are broadcast, at most ``most`` texts come back
        ids = known.where(F.col("toxic") == label).orderBy(F.xxhash64(id_col), id_col).limit(most).select(id_col)
        rows = texts(docs, id_col).where(fits).join(F.broadcast(ids), id_col, "left_semi")
        text[label] = [r.text for r in rows.orderBy(F.xxhash64(id_col), id_col, "text").limit(most).collect()]
    toxic, clean = (_without_copies([_normal(t) for t in text[label]]) for label in (1, 0))
    return build(toxic, clean)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row's whole text.

    Null texts count as empty and get a score like any other. A null id counts
    as held out. Labels of ids without a document, null labels and repeated
    labels (the largest counts) do no harm; without toxic labels every score is
    0. Repeated rows and ids give one row each, an empty table none. Extra
    columns are left out; ids are no input of a score.
    """
    model = trained(docs, labels, id_col)

    def score(batch: list[str]) -> dict[str, list]:
        return {"score": [model.score(t) for t in batch]}

    scored = map_texts(texts(docs, id_col), score, "score double")
    return scored.select(id_col, F.coalesce(fold(id_col) == HELD_FOLD, F.lit(True)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with all columns, without the rows whose text the classifier rejects.

    Rows go by their own text: null texts count as empty, repeated rows and
    repeated or null ids are judged one by one, an empty table stays empty.
    Only the text goes to Python; the other columns stay where they are.
    """
    model = trained(docs, labels, id_col)

    @F.arrow_udf("boolean")
    def civil(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") < 0.5 for t in text.to_pylist()], pa.bool_())

    return docs.where(civil(F.col("text").cast("string")))


@query("op9_toxicity")
def op9_toxicity(spark, folder):
    """Every document's toxicity, learned from the labels of four folds of five."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
