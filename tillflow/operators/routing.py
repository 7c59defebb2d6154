"""Which service handles a message, and where its answers go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillflow import vocabulary as v
from tillflow.functions.jsontext import json_object, quoted


def route_catalogue(spark: SparkSession) -> DataFrame:
    """The 19 routes with service, input topic and path parameters."""
    rows = [(route, service, v.IN_TOPIC[service], names, "/".join(["", route, *(f"{{{n}}}" for n in names)]))
            for route, service, names in v.ROUTES]
    return spark.createDataFrame(
        rows, "route string, service string, topic string, names array<string>, template string")


def _constant(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def service_of(route: Column) -> Column:
    """The service a route belongs to, NULL for an unknown route."""
    return _constant({route: service for route, service, _ in v.ROUTES})[route]


def match_route(df: DataFrame, path: str) -> DataFrame:
    """Add ``matched`` route and its ``params`` for a URL path or whole URL.

    A template is a literal head and parameters behind it, so the head of two
    or three segments and the number of segments name the template.
    """
    only_path = F.regexp_replace(F.regexp_replace(F.col(path), "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    parts = F.split(F.regexp_replace(only_path, "^/", ""), "/")
    known = _constant({f"{route}|{len(route.split('/')) + len(names)}": route for route, _, names in v.ROUTES})

    def head(n):
        return known[F.concat_ws("|", F.array_join(F.slice("parts_", 1, n), "/"), F.size("parts_").cast("string"))]

    found = df.withColumn("parts_", parts).withColumn("matched", F.coalesce(head(3), head(2)))
    filled = ~F.exists("parts_", lambda p: p == "")
    params = F.lit(None).cast("string")
    for names in ([], ["user_id"], ["item_id"], ["order_id"], ["user_id", "amount"],
                  ["item_id", "amount"], ["order_id", "item_id"]):
        of = [route for route, _, expected in v.ROUTES if expected == names]
        values = {n: quoted(F.try_element_at("parts_", F.size("parts_") - len(names) + i + 1))
                  for i, n in enumerate(names)}
        params = F.when(F.col("matched").isin(of), json_object(**values)).otherwise(params)
    return (found.withColumn("matched", F.when(filled, F.col("matched")))
                 .withColumn("params", F.when(F.col("matched").isNotNull(), params)).drop("parts_"))


def target_topic(topic: Column, default: str = v.DEFAULT_OUT_TOPIC) -> Column:
    return F.coalesce(topic, F.lit(default))


def is_batch(state: Column) -> Column:
    """Whether a state token marks a message about many items."""
    return F.coalesce(F.startswith(state, F.lit(v.BATCH_PREFIX)), F.lit(False))


def topic_filter(topic: Column, wanted: str, include: bool, include_none: bool) -> Column:
    return F.when(topic.isNotNull(), (topic == wanted) == F.lit(include)).otherwise(F.lit(include_none))


def unknown_state_text(state: Column) -> Column:
    return F.concat(F.lit("Unrecognised state: "),
                    F.coalesce(F.concat(F.lit('"'), state, F.lit('".')), F.lit("null.")))


def first_reason(*checks: tuple[Column, str | Column]) -> Column:
    """The text of the first check that holds, in the given order, else NULL."""
    reason = F.lit(None).cast("string")
    for failed, text in reversed(checks):
        reason = F.when(failed, text if isinstance(text, Column) else F.lit(text)).otherwise(reason)
    return reason
