"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

The first filter holds the listed keys. The second holds the keys of the corpus
that pass the first without being listed, the third the listed keys that pass
the second, and so on until no key of the corpus is judged wrongly. Judging a
key then needs no join. The first filter's error is set to the number of listed
keys over the number of keys in the corpus, so each further level holds about
as many keys as the list and the filters' size depends on the list alone, but
for a logarithm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import table
from tillflow.llm.registry import query
from tillflow.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, start of the path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
UNLISTED = "allow"
MOST_LEVELS = 60


@dataclass(frozen=True)
class Filter:
    """A Bloom filter: its bits as longs, how many bits, how many hashes, its level."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    level: int

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words])
        result = F.lit(True)
        for i in range(self.hashes):
            at = _position(key, self.level, i, self.bits)
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            result = result & (F.call_function("shiftrightunsigned", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
        return result


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long"))


def _build(keys: DataFrame, count: int, error: float, level: int) -> Filter:
    """A filter of ``keys(key)``; the driver gets its words, which ``count`` bounds."""
    hashes = max(1, round(-math.log2(error)))
    bits = max(64, math.ceil(count * -math.log2(error) / math.log(2)))
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), level, i, bits) for i in range(hashes)])).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("v")).collect()
    words = [0] * (bits // 64 + 1)
    for r in rows:
        words[r.word] = r.v
    return Filter(tuple(words), bits, hashes, level)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Filter]:
    """Filters that judge every key of ``universe`` and of ``listed`` rightly. Both have a column ``key``."""
    inside = written(listed.distinct(), "listed")
    outside = written(universe.join(inside, "key", "left_anti").distinct(), "unlisted")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Filter] = []
    if not n_in:
        return levels
    holds, others = (inside, n_in), outside
    error = min(0.5, n_in / max(1, n_out) / math.sqrt(2))
    while holds[1]:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("the cascade does not end: two keys share all hashes")
        levels.append(_build(holds[0], holds[1], error if not levels else 0.5, len(levels)))
        wrong = written(others.where(levels[-1].passes(F.col("key"))), "passing")
        holds, others = (wrong, wrong.count()), holds[0]
    return levels


def member(levels: list[Filter], key: Column) -> Column:
    """Whether ``key`` is listed: the first filter it does not pass decides."""
    result = F.lit(len(levels) % 2 == 1)
    for f in reversed(levels):
        result = F.when(f.passes(key), result).otherwise(F.lit(f.level % 2 == 1))
    return result


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between ``://`` and the path, lower-cased in A-Z, and the path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _candidates(rules: list[tuple[str, str, str]]) -> Column:
    """The keys a url could be listed under, longest first: as many labels and path characters as some rule has."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules}, reverse=True)
    keys = []
    for labels, length in shapes:
        host = F.substring_index("host", ".", -labels)
        enough = (F.length("host") - F.length(F.translate("host", ".", "")) >= labels - 1) & (F.length("path") >= length)
        keys.append(F.when(enough & (host != ""), F.concat(host, F.substring("path", 1, length))))
    return F.sort_array(F.array_distinct(F.array_compact(F.transform(F.array(*keys), lambda k: F.when(
        k.isNotNull(), F.struct(F.length(k).alias("n"), k.alias("key")))))), asc=False)


def judge(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest fitting rule decides, and a url that no rule fits is not on the
    list: allowed, with a null rule. Null urls and those without ``://`` have
    empty host and path. Repeated rows and repeated or null ids give one row
    each, an empty table none. Extra columns of ``pages`` are left out.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(id_col, host.alias("host"), path.alias("path"))
    if not rules:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(UNLISTED).alias("verdict"))
    keyed = parsed.withColumn("_keys", _candidates(rules))
    universe = keyed.select(F.explode("_keys.key").alias("key"))
    # rules are the caller's parameter, so these frames are as small as that list
    listed = spark.createDataFrame([(h + p,) for _, h, p in rules], "key string")
    blocked = spark.createDataFrame([(h + p,) for v, h, p in rules if v == "block"], "key string")
    universe = written(universe.distinct(), "keys")
    on_list, on_block = cascade(listed, universe), cascade(blocked, universe)
    first = F.get(F.filter("_keys.key", lambda k: member(on_list, k)), F.lit(0))
    judged = keyed.withColumn("rule", first)
    verdict = F.when(F.col("rule").isNull(), UNLISTED).when(member(on_block, F.col("rule")), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


@query("op5_url_rules", SQL)
def op5_url_rules(spark, folder):
    """Every page's url judged by the rules."""
    return judge(table(spark, folder, "pages"))
