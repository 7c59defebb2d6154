"""The message envelope: JSON text on the wire, structs inside Spark.

``params`` may hold anything and stays JSON text; the sections around it have
a fixed schema. Fields outside that schema are dropped on parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.functions.jsontext import json_object, quoted, raw, text_fields
from tillflow.vocabulary import WEB

PATH_POINT = "struct<consumer:string, route:string, state:string, state_id:string, params:string>"
ENVELOPE = ("input struct<request_id:string, consumer:string, route:string, params:string>, "
            "state struct<route:string, sender:string, state:string, state_id:string>, "
            "params string, "
            f"path array<{PATH_POINT}>, "
            "result struct<result:string, message:string, params:string>")


def make_envelope(request_id: Column, topic: Column, route: Column, params: Column) -> Column:
    """A request as the front end sends it: sender web, no state yet."""
    return json_object(
        input=json_object(request_id=quoted(request_id), consumer=quoted(topic),
                          route=quoted(route), params=raw(params)),
        params=raw(params),
        state=json_object(route=quoted(route), sender=quoted(F.lit(WEB)), state=F.lit("null")))


def parse_envelope(df: DataFrame, value: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """Replace the text column by the five sections; a bad record has all NULL.

    ``mode="FAILFAST"`` stops the query at the first bad record instead.
    """
    parsed = F.from_json(F.col(value), ENVELOPE, {"mode": mode}).alias("m_")
    rest = [c for c in df.columns if c != value]
    return (df.select(*rest, parsed).select(*rest, "m_.*")
              .withColumn("path", F.coalesce("path", F.expr(f"cast(array() as array<{PATH_POINT}>)"))))


def is_message() -> Column:
    """Whether a parsed row came from a readable record."""
    return F.col("input").isNotNull()


def split_malformed(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable records, and the raw text of the others with a reason."""
    kept = parse_envelope(df.withColumn("raw", F.col(value)), value)
    bad = kept.where(~is_message()).select(
        *[c for c in df.columns if c != value], "raw", F.lit("Unknown message format.").alias("reason"))
    return kept.where(is_message()).drop("raw"), bad


def _section(name: str, *texts: str, params: bool) -> Column:
    """A section as JSON: its text fields, and at the end its params, which are JSON already."""
    head = text_fields(**{t: F.col(f"{name}.{t}") for t in texts})
    end = [F.lit(',"params":'), raw(f"{name}.params")] if params else []
    return F.when(F.col(name).isNull(), F.lit("{}")).otherwise(F.concat(head, *end, F.lit("}")))


def _points(path: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(path, lambda p: F.concat(
        text_fields(consumer=p.consumer, route=p.route, state=p.state, state_id=p.state_id),
        F.lit(',"params":'), raw(p.params), F.lit("}"))), ","), F.lit("]"))


def serialize_envelope() -> Column:
    """All five sections, always: absent ones empty, NULL leaves as JSON null."""
    return json_object(
        input=_section("input", "request_id", "consumer", "route", params=True),
        state=_section("state", "route", "sender", "state", "state_id", params=False),
        params=raw("params"),
        path=_points(F.col("path")),
        result=_section("result", "result", "message", params=True))


def _with_step(service: Column) -> Column:
    """The audit path with the current state added as its newest point."""
    point = F.struct(service.alias("consumer"), F.col("state.route").alias("route"),
                     F.col("state.state").alias("state"), F.col("state.state_id").alias("state_id"),
                     F.col("params").alias("params"))
    return F.array_append(F.col("path"), point)


def emit(df: DataFrame, service: Column, kind: Column, route: Column, state: Column,
         params: Column, message: Column) -> DataFrame:
    """Turn handler results into outgoing envelopes.

    ``kind`` is ``redirect`` (goes on to ``route``/``state`` with ``params``)
    or one of success, failure, error (goes back to the front end).
    """
    onward = kind == "redirect"
    none = F.lit(None).cast("string")
    return (df.withColumns({
        "path": _with_step(service),
        "state_": F.struct(F.when(onward, route).otherwise(WEB).alias("route"), service.alias("sender"),
                           F.when(onward, state).alias("state"), none.alias("state_id")),
        "params_": F.when(onward, params),
        "result_": F.when(~onward, F.struct(kind.alias("result"), message.alias("message"),
                                            params.alias("params")))})
        .withColumns({"state": F.col("state_"), "params": F.col("params_"), "result": F.col("result_")})
        .drop("state_", "params_", "result_"))


def redirect(df: DataFrame, service: str, route: Column, state: Column, params: Column) -> DataFrame:
    return emit(df, F.lit(service), F.lit("redirect"), route, state, params, F.lit(None).cast("string"))


def reply(df: DataFrame, service: str, result: Column, message: Column, params: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return emit(df, F.lit(service), result, none, none, params, message)


def scrub_response(df: DataFrame) -> DataFrame:
    """A response as the caller sees it: only ``params`` and ``result`` are kept."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in ("input", "path", "state")})


def extract_key(param: str) -> Column:
    """The key in ``params``, else a new id.

    The new id is a hash of the request id, so a task that runs twice gives
    the same id again.
    """
    made = F.sha2(F.concat_ws(":", F.col("input.request_id"), F.lit(param)), 256)
    return F.coalesce(F.get_json_object("params", f"$.{param}"), made)


def keyed(df: DataFrame, param: str) -> DataFrame:
    return df.withColumn("state", F.col("state").withField("state_id", extract_key(param)))


def require_key(df: DataFrame, fail: bool = False) -> DataFrame:
    """Rows that have a state key; ``fail`` stops the query at the first without."""
    present = F.col("state.state_id").isNotNull()
    if not fail:
        return df.where(present)
    checked = F.when(present, F.col("state")).otherwise(
        F.raise_error(F.lit("a message must have a state id")).cast(df.schema["state"].dataType))
    return df.withColumn("state", checked)
