"""Personal data by bootstrapped contextual extraction.

Seeds are what plain rules find: e-mail and IP addresses, card and phone
numbers. The words around them are lexical patterns. Patterns and instances
(identifiers, however they are written) form a graph over the whole corpus,
which Spark scores in rounds: a pattern is as sure of a kind as its known
instances are, against all that else fills it; an unknown instance is as sure
as its patterns together. Sure instances count as known in the next round, and
all their mentions are added to the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import table
from tillflow.llm.registry import query
from tillflow.session import written

EMAIL, IP, CARD, PHONE = range(4)
KINDS = ("email", "ip", "card", "phone")
UNKNOWN = -1
# a pattern needs so many known instances and so much certainty, an instance so much; rounds end when nothing is new
LEAST_KNOWN, PATTERN_SURE, INSTANCE_SURE, ROUNDS = 3, 0.65, 0.7, 4
UNLABELLED = 0.5  # how much an unknown filler of the right form speaks against a pattern
BEFORE, BEHIND = 64, 32  # characters in which the words beside a mention are looked for

# -- the rules ---------------------------------------------------------------------
# Written so that no text takes more than linear time: runs of digits are taken whole,
# and the part before an @ is looked for from there.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def _quad(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _local_start(text: str, at: int, least: int) -> int:
    """Where the characters that may stand before an @ begin, looking back in growing steps."""
    low, step = at, 64
    while low > least:
        begin = max(least, low - step)
        last = None
        for last in NO_LOCAL.finditer(text, begin, low):
            pass
        if last is not None:
            return last.end()
        low, step = begin, step * 2
    return least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the rules find, in this order."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            start = _local_start(text, m.start(), done)
            if start < m.start():
                out.append((start, EMAIL, m.end()))
                done = m.end()
    for m in QUAD.finditer(text):
        if _quad(m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in DIGITS.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in DIALLED.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# -- mentions and their patterns ---------------------------------------------------
AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT|@)\s|\s@|@\s")
LAST_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
SPELLED = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})*{DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])")
DOT_ONLY = re.compile(DOT)
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ()./-]{0,2}[0-9])*+")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A number, or where it has too many digits the parts that its spaces make: with a + as many as a phone number has."""
    if len(NOT_DIGIT.sub("", text[start:end])) <= 19:
        yield start, end
        return
    groups = [(start + m.start(), start + m.end()) for m in re.finditer(r"[^ ]+", text[start:end])]
    i = 0
    while i < len(groups):
        low, high = groups[i]
        n = len(NOT_DIGIT.sub("", text[low:high]))
        if text[low] == "+":
            while i + 1 < len(groups):
                more = len(NOT_DIGIT.sub("", text[slice(*groups[i + 1])]))
                if n + more > 15:
                    break
                n, high, i = n + more, groups[i + 1][1], i + 1
        yield low, high
        i += 1


def _candidates(text: str) -> Iterator[tuple[int, int, str, int]]:
    """``(start, end, instance, forms)``: what may be an identifier; ``forms`` has a bit for each kind it may be."""
    for m in AT.finditer(text):
        local = LAST_LOCAL.search(text, max(0, m.start() - 64), m.start())
        domain = SPELLED.match(text, m.end())
        if local and domain:
            name = f"{local[0]}@{DOT_ONLY.sub('.', domain[0])}".lower()
            yield local.start(), domain.end(), f"e:{name}", 1 << EMAIL
    for m in COLONS.finditer(text):
        if any(c.isdigit() for c in m[0]):
            yield m.start(), m.end(), f"c:{m[0].lower()}", 1 << IP
    for m in NUMBER.finditer(text):
        for start, end in _pieces(text, m.start(), m.end()):
            groups = NOT_DIGIT.sub(" ", text[start:end]).split()
            digits, forms = "".join(groups), 0
            beside = text[start - 1:start] + text[end:end + 1]
            if not any(c.isalnum() or c == "_" for c in beside):
                if len(groups) == 4 and _quad(groups):
                    forms |= 1 << IP
                if 14 <= len(digits) <= 19 and luhn(digits):
                    forms |= 1 << CARD
                if 7 <= len(digits) <= 15:
                    forms |= 1 << PHONE
            yield start, end, _number_instance(groups, forms), forms


def _number_instance(groups: list[str], forms: int) -> str:
    # addresses keep their groups, other numbers are their digits; very long ones are no identifiers
    return ("q:" + ".".join(groups) if forms >> IP & 1 else "n:" + "".join(groups))[:64]


def _seed_instance(kind: int, text: str) -> str:
    if kind == EMAIL:
        return f"e:{text.lower()}"
    groups = NOT_DIGIT.sub(" ", text).split()
    return _number_instance(groups, 1 << kind)


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The words beside a mention: one to three before it, and one on each side."""
    before = ["0" if t[0].isdigit() else t.lower() for t in TOKEN.findall(text, max(0, start - BEFORE), start)[-3:]]
    behind = TOKEN.search(text, end, end + BEHIND)
    behind = "$" if behind is None else "0" if behind[0][0].isdigit() else behind[0].lower()
    before = ["^"] * (3 - len(before)) + before
    return [f"{before[2]} _", f"{before[1]} {before[2]} _", " ".join(before) + " _", f"{before[2]} _ {behind}"]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """``(start, end, kind, forms, instance, patterns)``; candidates do not overlap the base spans or each other."""
    out = [(s, e, k, 1 << k, _seed_instance(k, text[s:e]), patterns_at(text, s, e)) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    more, at = [], 0
    found = sorted(_candidates(text), key=lambda c: (c[0], -c[1]))
    last = 0
    for start, end, instance, forms in found:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start < last or at < len(taken) and taken[at][0] < end:
            continue
        more.append((start, end, UNKNOWN, forms, instance, patterns_at(text, start, end)))
        last = end
    return out + more


# -- the corpus --------------------------------------------------------------------
SPAN = "struct<start:int,kind:int,end:int>"
MENTION = "struct<start:int,end:int,kind:int,forms:int,instance:string,patterns:array<string>>"


def _found(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``(id, *keep, row, base, mentions)``; ``row`` tells apart rows of repeated ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    keys = [id_col, *keep]
    rows = docs.select(*keys, F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text_"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    schema = docs.sparkSession.createDataFrame([], f"{kinds}, row long, base array<{SPAN}>, mentions array<{MENTION}>").schema
    arrow = to_arrow_schema(schema)
    span, mention = ([f.name for f in arrow.field(n).type.value_type] for n in ("base", "mentions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, all_ = [], []
            for text in batch.column(len(keys) + 1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans.append([dict(zip(span, s)) for s in base])
                all_.append([dict(zip(mention, m)) for m in mentions(text, base)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys) + 1], pa.array(spans, arrow.field("base").type),
                 pa.array(all_, arrow.field("mentions").type)], schema=arrow)

    return written(rows.mapInArrow(run, schema), "mentions")


def _fits(kind: str | int) -> Column:
    """Whether ``forms`` has the bit of a kind, a number or the name of a column."""
    return F.expr(f"(forms & shiftleft(1, {kind})) <> 0")


def scored_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``(pattern, kind, sure)`` of the patterns that may tell a kind.

    ``edges`` has each (pattern, instance, forms) once, ``known`` (instance,
    kind, sure). A pattern's certainty is the sum of its known instances of the
    kind over all its instances and one; unknown ones of the kind's form weigh half.
    """
    each = edges.join(known, "instance", "left")
    sums = [F.count("*").alias("n")]
    for k in range(len(KINDS)):
        own = F.col("kind") == k
        fits = F.col("kind").isNull() & _fits(k)
        # added in millionths, so that no order of adding changes the outcome
        sums += [F.sum(F.when(own, F.round(F.col("sure") * 1e6).cast("long")).otherwise(0)).alias(f"sum{k}"), F.count_if(own).alias(f"known{k}"),
                 F.count_if(fits).alias(f"open{k}")]
    counted = each.groupBy("pattern").agg(*sums)
    options = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"known{k}").alias("known"), (
        F.col(f"sum{k}") / 1e6 / (F.col("n") - UNLABELLED * F.col(f"open{k}") + 1)).alias("sure")) for k in range(len(KINDS))])
    return counted.select("pattern", F.explode(options).alias("o")).where(
        (F.col("o.known") >= LEAST_KNOWN) & (F.col("o.sure") >= PATTERN_SURE)).select("pattern", "o.kind", "o.sure")


def scored_instances(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(instance, kind, sure)`` of the instances whose patterns together are sure of a kind that fits their form."""
    each = edges.join(patterns, "pattern").where(_fits("kind"))
    doubt = F.round(-1e9 * F.log(1 - F.col("sure"))).cast("long")
    each = each.groupBy("instance", "kind").agg((1 - F.exp(-F.sum(doubt) / 1e9)).alias("sure"))
    each = each.where(F.col("sure") >= INSTANCE_SURE).groupBy("instance").agg(
        F.max(F.struct("sure", (-F.col("kind")).alias("less"))).alias("best"))
    return each.select("instance", (-F.col("best.less")).alias("kind"), "best.sure")


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(instance, kind, sure)``: the seeds, and what their patterns discover in the whole corpus."""
    each = found.select(F.explode("mentions").alias("m")).select("m.*")
    # one row an instance; copies of a text add nothing
    seeds = written(each.where(F.col("kind") >= 0).groupBy("instance").agg(F.min("kind").alias("kind")).withColumn(
        "sure", F.lit(1.0)), "seeds")
    pairs = each.select("instance", "forms", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(
        F.bit_or("forms").alias("forms"))
    pairs = written(pairs, "pairs")
    # a pattern of fewer instances has not enough known ones and one to discover
    wide = pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_KNOWN).select("pattern")
    edges = written(pairs.join(wide, "pattern"), "edges")
    known = seeds
    for _ in range(rounds):
        patterns = written(scored_patterns(edges, known), "patterns")
        new = written(scored_instances(edges, patterns).join(seeds.select("instance"), "instance", "left_anti"), "instances")
        last = new.join(known.select("instance"), "instance", "left_anti").isEmpty()
        known = seeds.unionByName(new)
        if last:
            break
    return known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, base, found)`` for every row: what the rules find and what the corpus' patterns add.

    Both are arrays of (start, kind, end) in this order, in code points, kinds
    as numbered in ``KINDS``. Added spans never overlap base spans. An identifier
    that is known is added wherever it stands in another spelling. Null
    and empty texts have none. Repeated rows and ids and null ids give one row
    each; copies of a text count once for a pattern. An empty table gives
    none. ``keep`` names further columns to carry along, all others are left out.
    Ties between kinds go to the first listed.
    """
    clash = {c.lower() for c in keep} & {id_col.lower(), "row", "base", "mentions", "found"}
    if clash:
        raise ValueError(f"these names are taken: {sorted(clash)}")
    rows = _found(docs, id_col, text_col, keep)
    known = bootstrap(rows, rounds)
    open_ = rows.select("row", F.explode("mentions").alias("m")).select(
        "row", "m.start", "m.end", "m.instance", "m.forms").where(F.col("m.kind") == UNKNOWN)
    added = open_.join(known.select("instance", "kind"), "instance").where(_fits("kind")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.select(id_col, *keep, "row", "base").join(added, "row", "left").select(id_col, *keep, "base", F.coalesce("found", none).alias("found"))


def named(spans: str | Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with every span replaced by its kind in angle brackets, of overlapping ones the first.

    A null text stays null; otherwise as ``personal_data``.
    """
    rows = personal_data(docs, id_col, text_col, keep=(text_col,)).select(
        id_col, text_col, F.array_sort(F.concat("base", "found")).alias("spans_"))
    schema = rows.drop("spans_").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], f"<{KINDS[s['kind']]}>"]
                        at = s["end"]
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.schema.field(1).type)],
                                             names=batch.schema.names[:2])
    return rows.mapInArrow(run, schema)


@query("op11_pii")
def op11_pii(spark, folder):
    """Every document's personal data: counts and digest of what the rules find, and all spans."""
    found = personal_data(table(spark, folder, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(named("base").cast("binary"), 256).alias("base_sha256"),
                        named(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))
