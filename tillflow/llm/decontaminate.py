"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of ten words keeps the smallest hash of its six 5-grams. Two equal
windows keep the same one, so joining these fingerprints misses no shared
window; the documents found are then compared window by window, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import table, unused
from tillflow.llm.registry import query
from tillflow.session import written

WINDOW = 10
SALTS = 16  # a passage that very many documents hold is spread over so many tasks
GRAM = 5  # WINDOW - GRAM + 1 grams compete in each window
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; none of a null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN_WORDS, -1), "")


def _each_start(array: str, length: int, fn) -> Column:
    """``fn`` of every start of a run of ``length``; an empty array if there is none."""
    n = F.size(array)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), fn))


def _winnowed(df: DataFrame) -> DataFrame:
    """Adds ``_grams`` and ``_mins``: the fingerprint of each window of ``_words``."""
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_grams", _each_start("_hashes", GRAM, lambda i: F.xxhash64(
        *[F.get("_hashes", i + k) for k in range(GRAM)])))
    return df.withColumn("_mins", _each_start("_grams", WINDOW - GRAM + 1, lambda i: F.least(
        *[F.get("_grams", i + k) for k in range(WINDOW - GRAM + 1)])))


def _short(length: int) -> Column:
    """Hashes of all runs of ``length`` words, apart from those of other lengths."""
    return _each_start("_hashes", length, lambda i: F.xxhash64(
        F.lit(length), *[F.get("_hashes", i + k) for k in range(length)]))


def _fingerprints(df: DataFrame, short: list[int]) -> Column:
    parts = [F.col("_mins"), *[_short(n) for n in short]]
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))


def _runs(lengths: list[int]) -> Column:
    """``(at, n, run)`` for all runs of the given lengths, with their words."""
    none = F.array().cast("array<struct<at:int,n:int,run:string>>")

    def run(n: int):
        return lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"),
                                  F.array_join(F.slice("_words", i + 1, F.lit(n)), " ").alias("run"))
    return F.concat(*[F.coalesce(_each_start("_words", n, run(n)), none) for n in lengths])


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``.

    A window is ten consecutive words of an item, or all words of an item with
    fewer. A word of a document inside an occurrence of a window is hit; items
    are those with an occurring window. Null texts have no words, items without
    words no window. Rows of null item ids hit, but are no items. Repeated
    rows and repeated or null ids give one row each; equal texts are worked out
    once. Empty tables are fine on either side. Extra columns are left out.
    """
    return _judged(docs, benchmark, id_col, item_col).drop("digest")


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str = "item_id") -> DataFrame:
    """``contamination`` with each text's digest."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col("text")).alias("_words"))
    items = items.where(F.size("_words") > 0)
    # at most nine numbers: which items are shorter than a window
    short = sorted(r.n for r in items.where(F.size("_words") < WINDOW).select(F.size("_words").alias("n")).distinct().collect())
    lengths = [WINDOW, *short]
    marked = _winnowed(items)
    own = F.when(F.size("_words") >= WINDOW, F.col("_mins"))
    for n in short:
        own = F.when(F.size("_words") == n, _short(n)).otherwise(own)
    marks = marked.select(F.explode(own).alias("mark")).distinct()
    runs = items.select("item", F.explode(F.when(F.size("_words") >= WINDOW, F.filter(
        _runs([WINDOW]), lambda r: r["n"] == WINDOW)).otherwise(F.array(F.struct(
            F.lit(0).alias("at"), F.size("_words").alias("n"), F.array_join("_words", " ").alias("run"))))).alias("r"))
    runs = written(runs.select("item", F.col("r.run").alias("run")).distinct(), "windows")

    # one pass over all texts: a row of each document, and a row of each mark it shares with the benchmark
    every = docs.select(F.col(id_col), _digest(F.col("text")).alias("digest"),
                        words_of(F.col("text")).alias("_words"))
    every = _winnowed(every).select(id_col, "digest", F.size("_words").alias("n_words"),
                                    F.posexplode_outer(_fingerprints(every, short)).alias("at", "mark"))
    marks = marks.withColumn("shared", F.lit(True))
    passed = written(every.join(marks, "mark", "left").where("shared or coalesce(at, 0) = 0").select(
        id_col, "digest", "n_words", (F.coalesce("at", F.lit(0)) == 0).alias("head"),
        F.coalesce("shared", F.lit(False)).alias("shared")), "marks")

    # of equal texts one is compared with the windows themselves
    chosen = passed.where("shared").groupBy("digest").agg(F.min(id_col).alias("_chosen"))
    found = docs.select(F.col(id_col), F.col("text"), _digest(F.col("text")).alias("digest"))
    found = found.join(chosen, (found.digest == chosen.digest) & found[id_col].eqNullSafe(chosen._chosen), "left_semi")
    found = found.select("digest", words_of(F.col("text")).alias("_words"))
    found = found.select("digest", F.explode(_runs(lengths)).alias("r")).select("digest", "r.at", "r.n", "r.run")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt")
    spread = written(runs.select("item", "run", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "spread")
    hits = written(found.select("*", salt).join(spread.select("run", "salt").distinct(), ["run", "salt"], "left_semi").distinct(), "hits")

    covered = hits.select("digest", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("w")).distinct()
    covered = covered.groupBy("digest").agg(F.count("*").alias("n_hit"))
    named = hits.select("digest", "run", "salt").distinct().join(spread.where("item is not null"), ["run", "salt"])
    named = named.select("digest", "item").distinct()
    named = named.groupBy("digest").agg(F.count("*").alias("n_items"),
                                        F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    result = covered.join(named, "digest", "left")
    heads = passed.where("head").select(id_col, "digest", "n_words")
    zero = F.lit(0).cast("long")
    return heads.join(result, "digest", "left").select(
        id_col, "digest", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark.

    Rows go by their own text, whatever rows share their id.
    """
    name, = unused(docs.columns, "bad")
    bad = _judged(docs, benchmark, id_col).where("contaminated").select(F.col("digest").alias(name)).distinct()
    return docs.join(bad, _digest(F.col("text")) == F.col(name), "left_anti")


_WORDS = (f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
          "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, r.n, item_id FROM runs r JOIN windows USING (run)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op10_decontaminate", SQL)
def op10_decontaminate(spark, folder):
    """Every document with the words and items it shares with the benchmark."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
