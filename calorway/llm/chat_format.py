"""Route requests and responses as chat records: linked, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table

#: (argument, type, required, lowest, highest): numbers are bounded by value, strings by length; None is open.
REQUEST_SCHEMA = (
    ("depart_iso", "timestamp", True, None, None),
    ("destination", "string", True, 1, None),
    ("max_alternatives", "int", False, 1, 8),
    ("origin", "string", True, 1, None),
    ("profile", "string", False, 1, 100),
    ("walk_speed_ms", "double", False, 0.3, 3.0),
)


def request_depths(calls: DataFrame) -> DataFrame:
    """(request_id, depth): the longest chain of earlier requests that a request waits for; null inside or behind a cycle.

    `calls` has a row per request and request that it waits for, or null; waits for a request that does not exist count as
    none, repeated rows once. Requests with one wait form chains, which are followed by doubling: every round a request
    skips to where the one it points to points, so a chain of n takes about log2 n rounds. Chains end at requests without a
    wait or with several. Those with several are put in topological order in rounds of their own: one is placed once all
    that it waits for are, a step deeper than the deepest. What is never placed is on or behind a cycle. Empty calls give no row.
    """
    ids = calls.select("request_id").distinct()
    waits = calls.select("request_id", "after").distinct().join(ids.withColumnRenamed("request_id", "_known"), F.col("after") == F.col("_known")).drop("_known")
    waits = write_table(waits, "waits")
    count = waits.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("one"))
    single = F.col("n") == 1
    state = write_table(ids.join(count, "request_id", "left").select(
        "request_id", F.when(single, F.col("one")).alias("up"), F.when(single, 1).otherwise(0).cast("long").alias("steps"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("several")), "chains")
    rounds, moved = max(1, state.count()).bit_length() + 1, True
    while moved and rounds:
        there = state.select(F.col("request_id").alias("_id"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        new = write_table(state.join(there, F.col("up") == F.col("_id"), "left").select(
            "request_id", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.when(F.col("_up").isNotNull(), F.col("_steps")).otherwise(0)).alias("steps"),
            "several", F.col("_up").isNotNull().alias("moved")), "chains")
        drop_table(state)
        state, rounds = new, rounds - 1
        moved = not state.filter("moved").isEmpty()
    # a chain that still moves after so many doublings runs in a circle
    based = state.select("request_id", F.when(~F.col("moved"), F.coalesce("up", "request_id")).alias("base"), "steps", "several")
    ends = based.select(F.col("request_id").alias("_p"), F.col("base"), F.col("steps"))
    open_waits = write_table(waits.join(based.filter("several").select("request_id"), "request_id", "left_semi").join(ends, F.col("after") == F.col("_p"))
                             .select("request_id", "base", (F.col("steps") + 1).alias("steps"), F.lit(False).alias("met")), "waits")
    placed = write_table(based.filter("base = request_id AND NOT several").select("request_id", F.lit(0).cast("long").alias("depth")), "placed")
    done = [placed]
    while not (open_waits.isEmpty() or placed.isEmpty()):
        at = placed.select(F.col("request_id").alias("_b"), F.col("depth").alias("_depth"))
        here = F.col("_b").isNotNull()
        left = write_table(open_waits.join(at, F.col("base") == F.col("_b"), "left").select(
            "request_id", F.when(~here, F.col("base")).alias("base"), (F.col("steps") + F.coalesce("_depth", F.lit(0))).alias("steps"), (here | F.col("met")).alias("met")), "waits")
        ready = left.groupBy("request_id").agg(F.bool_and("met").alias("_all"), F.max("steps").alias("depth")).filter("_all").select("request_id", "depth")
        placed = write_table(ready, "placed")
        rest = write_table(left.join(placed.select("request_id"), "request_id", "left_anti"), "waits")
        drop_table(open_waits)
        drop_table(left)
        open_waits = rest
        done.append(placed)
    bases = done[0]
    for part in done[1:]:
        bases = bases.unionByName(part)
    bases = bases.select(F.col("request_id").alias("_b"), F.col("depth").alias("_depth"))
    return based.join(bases, F.col("base") == F.col("_b"), "left").select("request_id", (F.col("_depth") + F.col("steps")).alias("depth"))


def _errors(schema):
    """One array of messages from the schema table, compiled into a projection."""
    checks = []
    for name, kind, required, low, high in schema:
        raw = F.col(f"arguments.{name}").cast("string")
        typed = raw if kind == "string" else raw.try_cast(kind)
        size = F.length(raw) if kind == "string" else typed
        if required:
            checks.append(F.when(raw.isNull(), F.lit(f"{name}: missing")))
        if kind != "string":
            checks.append(F.when(raw.isNotNull() & typed.isNull(), F.lit(f"{name}: not a {kind}")))
        if low is not None:
            checks.append(F.when(size < low, F.lit(f"{name}: below {low}")))
        if high is not None:
            checks.append(F.when(size > high, F.lit(f"{name}: above {high}")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def link_route_calls(calls: DataFrame, results: DataFrame, schema=REQUEST_SCHEMA) -> DataFrame:
    """(request_id, status, depth, valid, errors, record) of route calls and their responses.

    `calls` has request_id, after (the request that a call waits for, or null) and
    arguments, a struct with the schema's fields; `results` has request_id and content.
    Calls meet results by a join on request_id: status is linked, no_result, or no_call
    for a result without a call. depth is the call's place in the order of waiting (0
    first; null on a cycle). valid says whether the arguments fit `schema`, errors lists
    what does not. `record` is one JSON text with sorted keys, no spaces and null fields
    left out.

    Null ids link to nothing and are returned as no_result or no_call. Several results of
    one id give a row each, so do repeated calls. Other columns are ignored; empty tables
    give what the other side has.
    """
    fields = sorted(name for name, *_ in schema)
    asked = calls.select("request_id", "after", F.struct(*[F.col(f"arguments.{f}").alias(f) for f in fields]).alias("arguments"))
    depths = request_depths(asked.filter("request_id is not null").select("request_id", "after")).withColumnRenamed("request_id", "_id")
    asked = (asked.withColumn("errors", _errors(schema)).join(depths, F.col("request_id") == F.col("_id"), "left").drop("_id")
             .withColumn("_call", F.lit(True)))
    given = results.select(F.col("request_id").alias("_rid"), F.col("content").cast("string").alias("content"), F.lit(True).alias("_result"))
    both = asked.join(given, F.col("request_id") == F.col("_rid"), "full_outer")
    rid = F.coalesce("request_id", "_rid")
    status = F.when(F.col("_result").isNull(), "no_result").when(F.col("_call").isNull(), "no_call").otherwise("linked")
    record = F.to_json(F.struct(F.when(F.col("_call"), F.col("after")).alias("after"), F.col("arguments"), F.col("content"),
                                rid.alias("request_id"), status.alias("status")))
    return both.select(rid.alias("request_id"), status.alias("status"), "depth", F.coalesce(F.size("errors") == 0, F.lit(False)).alias("valid"),
                       F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), record.alias("record"))
