"""Instance inventory: classification, reconciliation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DELETE_AFTER_MISSES = 2  # fixed value


def lower_tags(tags: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def classify_env(df: DataFrame, keys: list[str], mapping: dict[str, str]) -> DataFrame:
    """Environment by the first tag key, in the given order, whose value is mapped; both compared without case."""
    table = F.create_map(*[F.lit(x.lower() if i == 0 else x) for kv in mapping.items() for i, x in enumerate(kv)])
    tag = lambda k: F.try_element_at(table, F.lower(F.try_element_at(lower_tags(F.col("tags")), F.lit(k.lower()))))
    return df.withColumn("env", F.coalesce(*map(tag, keys), F.lit("unknown")))


def discovery_verdict(df: DataFrame, vpcs: list[str], required: list[str], denied: str) -> DataFrame:
    """The first rule that fails."""
    missing = F.exists(F.array(*map(F.lit, required)), lambda k: ~F.coalesce(F.map_contains_key(lower_tags(F.col("tags")), F.lower(k)), F.lit(False)))
    return df.withColumn("verdict", F.when(~F.col("vpc_id").isin(vpcs), "vpc").when(missing, "required_tag").when(F.col("name").rlike(denied), "denied_name").otherwise("accepted"))


def parse_version(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"^(\d+)\.(\d+)\.?(\d*)", i).try_cast("int")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), F.coalesce(part(3), F.lit(0)).alias("patch"))


def reconcile(known: DataFrame, found: DataFrame, excluded: DataFrame | None = None, scopes: DataFrame | None = None, now_ms: int = 0, interval_ms: int = 0, truncated: bool = False) -> DataFrame:
    """What a discovery round does with each id: id, name, action, missing_count.

    ``known``: id, name, missing_count and, if there, scope, state, deleted, last_missing_ms. ``found`` and ``excluded``: ids of the
    round; ``scopes``: what it looked at (all, if none). Found rows are inserted or updated. Of the others, deleted ones stay as they
    are; filtered ones are excluded, never deleted; nothing is missing in a truncated round or out of its scopes. A row is deleted
    after two misses, and misses within half an interval are one.
    """
    has = lambda c, otherwise: F.coalesce(F.col(f"k.{c}"), F.lit(otherwise)) if c in known.columns else F.lit(otherwise)
    mark = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    both = known.alias("k").join(found.alias("f"), "id", "full_outer")
    out, seen, had = F.lit(False), F.col("f.name").isNotNull(), F.col("k.name").isNotNull()
    outside = F.lit(False)
    if excluded is not None:
        both = both.join(mark(excluded.select("id"), "filtered_out").alias("x"), "id", "left")
        out = F.coalesce("filtered_out", F.lit(False))
    if scopes is not None:
        both = both.join(mark(scopes.select(F.col("scope").alias("looked_at")), "in_scope").alias("s"), F.col("k.scope") == F.col("looked_at"), "left")
        outside = ~F.coalesce("in_scope", F.lit(False))
    soon = F.lit(now_ms) - has("last_missing_ms", -(2**53)) < interval_ms / 2
    count = F.coalesce("k.missing_count", F.lit(0))
    misses = count + F.when(soon, 0).otherwise(1)
    action = (
        F.when(seen & ~had, "insert").when(seen, "update").when(has("deleted", False), "none").when(out, F.when(has("state", "") == "excluded", "none").otherwise("excluded"))
        .when(F.lit(truncated), "skipped").when(outside, "out_of_scope").when(misses >= DELETE_AFTER_MISSES, "deleted").otherwise("missing")
    )
    kept = F.when(seen, 0).when(action.isin("missing", "deleted"), misses).otherwise(count)
    return both.select("id", F.coalesce("f.name", "k.name").alias("name"), action.alias("action"), kept.cast("int").alias("missing_count"))


def inventory_report(actions: DataFrame) -> DataFrame:
    """Rows of each action, and whether more than half of the round's rows are errors."""
    out = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    errors = F.sum(F.when(F.col("action") == "error", F.col("n")).otherwise(0)).over(Window.partitionBy())  # one row per action
    return out.withColumn("mostly_failing", errors * 2 > F.sum("n").over(Window.partitionBy()))


def set_difference(desired: DataFrame, running: DataFrame) -> DataFrame:
    """What to start and what to stop."""
    start = desired.join(running, "id", "left_anti").select("id", F.lit("start").alias("action"))
    return start.unionByName(running.join(desired, "id", "left_anti").select("id", F.lit("stop").alias("action")))


#: States of an instance that does not serve; order in which environments are shown.
NOT_SERVING = (
    "creating", "deleting", "failed", "inaccessible-encryption-credentials", "inaccessible-encryption-credentials-recoverable", "incompatible-network",
    "incompatible-restore", "restore-error", "starting", "stopped", "stopping",
)
ENVS = ("prod", "stage", "dev")


def supported(version: Column, least: tuple[int, int, int]) -> Column:
    """A triple at or above the least one; what has no triple is not supported."""
    floor = F.struct(*[F.lit(x).alias(n) for n, x in zip(("major", "minor", "patch"), least)])
    return F.coalesce(version["major"].isNotNull() & version["minor"].isNotNull() & (version >= floor), F.lit(False))


def initial_state(df: DataFrame, enabled_tag: str, least: tuple[int, int, int]) -> DataFrame:
    """disabled by tag, else unsupported, else unreachable, else pending."""
    tag = F.lower(F.trim(F.try_element_at(lower_tags(F.col("tags")), F.lit(enabled_tag.lower()))))
    serving = ~F.lower(F.trim("status")).isin(*NOT_SERVING)
    state = F.when(tag.isin("false", "0"), "disabled").when(~supported(parse_version(F.col("version")), least), "unsupported").when(~serving, "unreachable").otherwise("pending")
    return df.withColumn("state", state)


def collectible(instances: DataFrame, pauses: DataFrame) -> DataFrame:
    """Live, supported instances with an endpoint that no pause covers. Pauses: scope 'all', 'env:<env>' or 'id:<id>'."""
    able = instances.filter(F.col("live") & F.col("supported") & F.col("endpoint").isNotNull())
    scopes = F.array(F.lit("all"), F.concat(F.lit("env:"), "env"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    paused = able.select("id", F.explode(scopes).alias("scope")).join(pauses.select("scope"), "scope", "left_semi").select("id")
    return able.join(paused, "id", "left_anti")


def freshness(successes: DataFrame, live: DataFrame) -> DataFrame:
    """Oldest last success among live instances."""
    last = successes.join(live, "instance_id", "left_semi").groupBy("instance_id").agg(F.max("at_ms").alias("at_ms"))
    return last.agg(F.min("at_ms").alias("oldest_success_ms"), F.count(F.lit(1)).alias("instances"))


def fleet_table(instances: DataFrame, catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """Every metric of the catalog for every instance, with its newest value; cluster metrics are keyed by cluster.

    The catalog has a row per metric, so it rides along as an array.
    """
    metrics = catalog.agg(F.collect_list(F.struct("metric", "scope")).alias("m"))
    wide = instances.join(F.broadcast(metrics)).select("*", F.explode("m").alias("c")).drop("m")
    keyed = wide.select("instance_id", F.col("c.metric").alias("metric"), F.when(F.col("c.scope") == "cluster", F.col("cluster_id")).otherwise(F.col("instance_id")).alias("key"))
    return keyed.join(latest.select(F.col("instance_id").alias("key"), "metric", "at_ms", "value"), ["key", "metric"], "left").drop("key")


def visible_envs(df: DataFrame) -> DataFrame:
    """Environments present: the known ones in their order, then the rest by name."""
    known = F.array_position(F.array(*map(F.lit, ENVS)), F.col("env"))
    rank = F.when(known > 0, known).otherwise(len(ENVS) + 1)
    return df.select("env").distinct().withColumn("position", rank.cast("bigint")).orderBy("position", "env")


def assemble_table_specs(index_columns: DataFrame) -> DataFrame:
    """A row per table with its indexes, each with its columns in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "column_name"))), lambda c: c["column_name"])
    indexes = index_columns.groupBy("table_name", "index_name").agg(ordered.alias("columns"))
    return indexes.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("index_name", "columns"))).alias("indexes"))


def schema_fingerprint(specs: DataFrame) -> DataFrame:
    """Hash of each table's index layout, whatever the order in which it was read."""
    lines = F.transform("indexes", lambda i: F.concat(i["index_name"], F.lit("("), F.array_join(i["columns"], ","), F.lit(")")))
    return specs.select("table_name", F.sha2(F.array_join(F.array_sort(lines), "\n"), 256).alias("fingerprint"))
