"""Tool-call linking: calls meet their results by identifier, follow what they depend on, and become canonical JSON.

All of it is DataFrame work: one hash join of calls and results, one round of joins for each level of dependency,
and JSON as variants, whose objects keep their fields in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stage

#: For each tool its fields: (type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted error texts of a call's JSON arguments against the schema of its tool."""
    value = F.try_parse_json(arguments)
    none = F.expr("cast(array() as array<string>)")

    def of(fields: dict[str, tuple[str, bool]]) -> Column:
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            missing = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
            checks.append(F.when(found.isNull(), missing).when(~found.rlike(f"^(?:{_TYPES[kind]})$"), F.lit(f"{field} is not {kind}")))
        known = F.array(*(F.lit(f) for f in fields)) if fields else none
        extra = F.transform(F.array_except(F.json_object_keys(arguments), known), lambda k: F.concat(F.lit("unknown "), k))
        return F.concat(F.array_compact(F.array(*checks)) if checks else none, extra)

    is_object = F.schema_of_variant(value).startswith("OBJECT")
    out = F.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("malformed arguments")))
    for tool, fields in sorted(schemas.items()):
        out = out.when(name == tool, of(fields))
    return F.array_sort(out.otherwise(F.array(F.lit("unknown tool"))))


def dependency_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) by Kahn's rounds; a call on a cycle or behind one has no row.

    ``needs`` holds (conv_id, call_id, dep) between known calls. Every round takes the calls whose dependencies all
    have a level, and is written to the shared folder.
    """
    key = ["conv_id", "call_id"]
    levels = stage(calls.select(*key).join(needs, key, "left_anti").withColumn("level", F.lit(0)), "levels")
    pending, frontier, k = needs, levels, 0
    while True:
        k += 1
        ready = frontier.select("conv_id", F.col("call_id").alias("dep"))
        left = stage(pending.join(ready, ["conv_id", "dep"], "left_anti"), "pending")
        frontier = stage(pending.select(*key).distinct().join(left, key, "left_anti").withColumn("level", F.lit(k)), "levels")
        if frontier.isEmpty():
            return levels
        levels, pending = levels.unionByName(frontier), left


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, name, level, position, status, errors, n_results, json), a row for each call and each
    result without a call.

    ``calls`` holds conv_id, call_id, name, arguments (JSON text), depends_on (array of call ids), position;
    ``results`` conv_id, call_id, content, position; further columns are ignored. Level, then position, is an order
    in which every call follows what it depends on. Status is ``cycle``, ``invalid`` (errors), ``unanswered``,
    ``ok`` or ``orphan``. Of repeated identifiers the first by position counts and the error ``repeated id`` is set;
    of repeated results likewise, and n_results tells their number. A call without an identifier is invalid and
    links to nothing. Null names and arguments are errors; empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", "name", "arguments", "depends_on", "position")
    results = results.select("conv_id", "call_id", "content", "position")
    body = F.struct("position", "name", "arguments", "depends_on")
    first = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(body).alias("c"), F.count("*").alias("n_calls")).select(*key, "c.*", "n_calls")
    answer = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(
        F.min(F.struct("position", "content"))["content"].alias("result"), F.count("*").alias("n_results")
    )
    first = stage(first, "calls")
    wanted = first.select(*key, F.explode("depends_on").alias("dep")).where("dep is not null").distinct()
    known = first.select("conv_id", F.col("call_id").alias("dep"))
    needs = stage(wanted.join(known, ["conv_id", "dep"], "left_semi").select(*key, "dep"), "needs")
    lost = wanted.join(known, ["conv_id", "dep"], "left_anti").groupBy(*key).agg(F.count("*").alias("lost"))
    linked = (
        first.withColumn("is_call", F.lit(True)).join(answer, key, "full")
        .join(dependency_levels(first, needs), key, "left").join(lost, key, "left")
    )
    loose_calls = calls.where("conv_id is null or call_id is null").withColumns({"is_call": F.lit(True), "n_calls": F.lit(1)})
    loose_results = results.where("conv_id is null or call_id is null").select(*key, F.col("content").alias("result"), "position", F.lit(1).alias("n_results"))
    rows = linked.unionByName(loose_calls, allowMissingColumns=True).unionByName(loose_results, allowMissingColumns=True)
    is_call, nameless = F.coalesce("is_call", F.lit(False)), F.col("conv_id").isNull() | F.col("call_id").isNull()
    own = F.array_compact(
        F.array(
            F.when(nameless, F.lit("no id")), F.when(F.col("n_calls") > 1, F.lit("repeated id")), F.when(F.col("lost") > 0, F.lit("unknown dependency"))
        )
    )
    errors = F.array_sort(F.concat(own, argument_errors(F.col("name"), F.col("arguments"), schemas)))
    rows = rows.withColumn("errors", F.when(is_call, errors).otherwise(F.expr("cast(array() as array<string>)")))
    cyclic = F.col("level").isNull() & ~nameless
    status = (
        F.when(~is_call, "orphan").when(cyclic, "cycle").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("ok")
    )
    return rows.select(
        *key, "name", "level", F.when(is_call, F.col("position")).alias("position"), status.alias("status"), F.array_join("errors", ";").alias("errors"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "name", "result")).alias("json"),
    )
