"""Requests, devices and application logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.functions import text as X

MAX_DEVICES = 3
#: Header of a log record: time, level, module, place, message (fixed value).
LOG_HEADER = r"^\[(.*?)\] \[(.*?)\] \[(.*?)\] \[(.*?)\] - (.*)$"


def admission_replay(events: DataFrame, keys: DataFrame) -> DataFrame:
    """events (event_id, key, device, ts) with outcome accepted, unknown_key, inactive_key or device_limit.

    keys: key, is_active, max_devices (3 if null), bound (array of devices bound before, may be null). The devices of a key that come first (bound
    ones before all, then by first time, then by name) are admitted up to max_devices; ranks are taken over distinct devices, not over events. A null device is a device
    like any other; a null key is unknown.
    """
    known = keys.select("key", "is_active", F.coalesce("max_devices", F.lit(MAX_DEVICES)).alias("max_devices"), F.coalesce("bound", F.array().cast("array<string>")).alias("bound"))
    seen = events.groupBy("key", "device").agg(F.min(F.struct("ts", "event_id")).alias("first")).withColumn("_old", F.lit(1))
    bound = known.select("key", F.explode("bound").alias("device"))
    devices = seen.join(bound.distinct().withColumn("_bound", F.lit(0)), ["key", "device"], "left")
    extra = bound.groupBy("key").agg(F.countDistinct("device").alias("_n"))
    # Devices bound before take their places even if they make no request.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("first", "device"))
    new = devices.where("_bound is null").withColumn("place", rank).join(extra, "key", "left").select("key", "device", (F.col("place") + F.coalesce("_n", F.lit(0))).alias("place"))
    placed = new.union(devices.where("_bound = 0").select("key", "device", F.lit(0)))
    placed = placed.toDF("_key", "_device", "place")
    joined = events.join(placed, events["key"].eqNullSafe(F.col("_key")) & events["device"].eqNullSafe(F.col("_device")), "left").join(known.drop("bound"), "key", "left")
    outcome = F.when(F.col("is_active").isNull(), "unknown_key").when(~F.col("is_active"), "inactive_key").when(F.coalesce("place", F.lit(1)) <= F.col("max_devices"), "accepted").otherwise("device_limit")
    return joined.withColumn("outcome", outcome).select(*events.columns, "outcome")


def usage_totals(replayed: DataFrame) -> DataFrame:
    """Per key: accepted requests and the devices bound, sorted."""
    return replayed.where("outcome = 'accepted'").groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.array_sort(F.collect_set("device")).alias("devices"))


def latest_devices(logins: DataFrame) -> DataFrame:
    """The last login (ts, then event_id) of each user and device, newest first within a user."""
    last = F.max(F.struct("ts", "event_id"))
    found = logins.groupBy("user_id", "device").agg(last.alias("_l"), F.count(F.lit(1)).alias("logins")).select("user_id", "device", "_l.ts", "_l.event_id", "logins")
    return found.orderBy("user_id", F.desc("ts"), F.desc("event_id"))


def parse_logs(lines: DataFrame) -> DataFrame:
    """file, record, ts, level (without the white space that pads it), module, place, message of log lines (file, line_no, value); lines without a header belong to the record before, those before the first header go.

    record is the place of the header's line among the lines of its file. line_no is a struct (block, n) that ascends within a file; the lines of one block of a file are numbered together, so a large file is
    worked on in as many tasks as it has blocks, and lines before a block's first header go to the last header of the blocks before it.
    """
    by_block = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    split = lines.select("file", F.col("line_no.block").alias("block"), F.col("line_no.n").alias("n"), "value")
    marked = split.withColumn("_own", F.last(F.when(F.col("value").rlike(LOG_HEADER), F.col("n")), ignorenulls=True).over(by_block))
    # The last header of each block, and so that of all blocks before: one row a block.
    ends = split.groupBy("file", "block").agg(F.max(F.when(F.col("value").rlike(LOG_HEADER), F.col("n"))).alias("_end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    placed = marked.join(ends, ["file", "block"]).withColumn("record", F.coalesce("_own", "_before")).where("record is not null")
    whole = placed.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("_p")).withColumn("_h", F.col("_p")[0]["value"])
    field = lambda n: F.regexp_extract("_h", LOG_HEADER, n)
    more = F.transform(F.slice("_p", F.lit(2), F.size("_p")), lambda x: x["value"])
    return whole.select("file", "record", field(1).alias("ts"), X.strip(field(2)).alias("level"), field(3).alias("module"), field(4).alias("place"), F.array_join(F.concat(F.array(field(5)), more), "\n").alias("message"))


def filter_logs(logs: DataFrame, level: str | None = None, module: str | None = None, keyword: str | None = None) -> DataFrame:
    if level:
        logs = logs.where(F.col("level") == level.upper())
    if module:
        logs = logs.where(F.col("module") == module)
    if keyword:
        logs = logs.where(F.lower("message").contains(keyword.lower()))
    return logs


def newest_logs(logs: DataFrame) -> DataFrame:
    """Parsed records, newest first: by time, then as they stand in their file, from its end."""
    return logs.orderBy(F.desc("ts"), "file", F.desc("record"))


def log_modules(logs: DataFrame) -> DataFrame:
    """Distinct modules, sorted."""
    return logs.select("module").distinct().orderBy("module")
