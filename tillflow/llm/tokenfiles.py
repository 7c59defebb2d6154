"""Token ids in files: each document compressed on its own with one shared dictionary.

A token file is a Parquet folder, so that Spark commits it whole and any store
can hold it. Each row is a block of documents in ascending id order: the sha256
of the dictionary, the width of an id, the documents' ids and token counts, the
offset of each document's zstandard frame, and the frames. One short document
is read by its offset, without unpacking its neighbours.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tillflow.llm import units
from tillflow.llm.frames import kept, map_texts, sampled, table, texts
from tillflow.llm.registry import query
from tillflow.llm.tokencounts import VOCABULARY, added_tokens, part_ids, tokenizer, words_ids
from tillflow.session import fresh_path, written

END_ID = 0
LEVEL = 3
# the dictionary is trained on at most so many documents of at most so many bytes
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 15, 1 << 16
# this operator spends its time on new words, so a worker remembers more parts than others do (some 400 MB)
REMEMBERED = 2_000_000
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
BLOCK = ("part int, block int, start long, first_id long, last_id long, dictionary string, width int, "
         "ids array<long>, n_tokens array<long>, offsets array<long>, frames binary")


@dataclass(frozen=True)
class Coder:
    """How ids become bytes: the tokenizer file, the width of an id, the dictionary."""

    path: str
    width: int
    dictionary: bytes

    @cached_property
    def hash(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()

    def _dictionary(self):
        return zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def compressor(self):
        def make():
            own = self._dictionary()
            if own:
                own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        return kept(f"compressor {self.hash}", make)

    def decompressor(self):
        return kept(f"decompressor {self.hash}", lambda: zstandard.ZstdDecompressor(dict_data=self._dictionary()))

    def serialize(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, each in ``width`` bytes, little-endian."""
        tok = tokenizer(self.path)
        parts = kept(f"parts {self.path} {self.width}", lambda: units.Parts(
            units.packed(part_ids(tok), self.width), REMEMBERED, words_ids(tok, self.width), added_tokens(tok)))
        end = END_ID.to_bytes(self.width, "little")
        return [data + end for data in units.encode_batch(texts, parts)]

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor().decompress(frame), f"<u{self.width}").astype("<u4")


def trained(docs: DataFrame, path: str, id_col: str) -> Coder:
    """A coder whose dictionary is trained on the sample: the rows with the smallest hashes of their ids."""
    from tokenizers import Tokenizer
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    plain = Coder(path, width, b"")
    sample = sampled(texts(docs, id_col), id_col, SAMPLE_DOCS, SAMPLE_BYTES)
    try:
        found = zstandard.train_dictionary(DICTIONARY_BYTES, plain.serialize(sample), level=LEVEL)
    except zstandard.ZstdError:  # too few texts for a dictionary: frames go without
        return plain
    return Coder(path, width, found.as_bytes())


def _pack(coder: Coder):
    """Rows of (id, n_tokens, frame) in order -> blocks."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("first_id", pa.int64()),
                        ("last_id", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()),
                        ("ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
                        ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, block = TaskContext.get().partitionId(), 0, 0
        ids, counts, offsets, frames = [], [], [0], []

        def full():
            nonlocal start, block, ids, counts, offsets, frames
            real = [i for i in ids if i is not None]
            row = {"part": part, "block": block, "start": start, "first_id": min(real, default=None),
                   "last_id": max(real, default=None), "dictionary": coder.hash, "width": coder.width, "ids": ids,
                   "n_tokens": counts, "offsets": offsets, "frames": b"".join(frames)}
            start, block = start + sum(counts), block + 1
            ids, counts, offsets, frames = [], [], [0], []
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for i, n, frame in zip(*[c.to_pylist() for c in batch.columns]):
                ids.append(i)
                counts.append(n)
                offsets.append(offsets[-1] + len(frame))
                frames.append(frame)
                if len(ids) >= BLOCK_DOCS or offsets[-1] >= BLOCK_BYTES:
                    yield full()
        if ids:
            yield full()

    return run


def write_token_files(docs: DataFrame, target: str, id_col: str = "doc_id", path: str | None = None) -> Coder:
    """Encode every row's whole text and write the files in ascending id order.

    Null texts count as empty (the end id alone), null ids come first, rows of
    equal ids are ordered by their ids and bytes. Ids must be integers. An empty
    table gives a folder without blocks. Extra columns are left out.
    """
    coder = trained(docs, path or public_tokenizers.path(VOCABULARY), id_col)

    def encode(batch: list[str]) -> dict[str, list]:
        made = {"n": [], "frame": []}
        squeeze = coder.compressor().compress
        for data in coder.serialize(batch):
            made["n"].append(len(data) // coder.width)
            made["frame"].append(squeeze(data))
        return made

    encoded = map_texts(texts(docs, id_col).withColumnRenamed(id_col, "id"), encode, "n long, frame binary")
    # written first: ranging samples its input, which must not encode everything twice
    encoded = written(encoded.select(F.col("id").cast("long").alias("id"), "n", "frame"), "frames")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(shuffles, "id").sortWithinPartitions("id", "n", "frame")
    ordered.mapInArrow(_pack(coder), BLOCK).write.option("compression", "none").parquet(target)
    return coder


def read_token_files(spark: SparkSession, source: str, coder: Coder) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, in any row order.

    start counts the ids of all documents before it, over all files.
    """
    blocks = spark.read.parquet(source)
    # one number for each range that was written
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before, total = {}, 0
    for row in sorted(totals.collect()):
        before[row.part], total = total, total + row.n

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != coder.hash:
                    raise ValueError("these files were written with another dictionary")
                out, start = [], before[row["part"]] + row["start"]
                for k, i in enumerate(row["ids"]):
                    ids = coder.ids(row["frames"][row["offsets"][k]:row["offsets"][k + 1]])
                    out.append({"id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                    start += len(ids)
                yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.select("part", "start", "dictionary", "ids", "offsets", "frames").mapInArrow(
        run, "id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, source: str, coder: Coder, doc_id: int) -> list[list[int]]:
    """The ids of the rows with this id, unpacking only their frames."""
    here = spark.read.parquet(source).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = here.select("frames", F.explode(F.arrays_zip("ids", F.slice("offsets", 1, F.size("ids")).alias("from"),
                                                      F.slice("offsets", 2, F.size("ids")).alias("to"))).alias("d"))
    at = at.where(F.col("d.ids") == doc_id).select(
        F.expr("substring(frames, int(d.from) + 1, int(d.to - d.from))").alias("frame"))
    return [coder.ids(bytes(r.frame)).tolist() for r in at.collect()]


@query("op4_token_files")
def op4_token_files(spark, folder):
    """Write all documents as token files and describe them from the files."""
    target = fresh_path(spark, "tokens")
    coder = write_token_files(table(spark, folder, "documents"), target)
    return read_token_files(spark, target, coder).withColumnRenamed("id", "doc_id")
