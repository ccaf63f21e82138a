"""Chat history windows, query logs and the context for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.functions import text as X

FALLBACK_TURNS = 6
NO_HIT = "未检索到相关资讯。"


def recent_turns(conv: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return conv.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def observation_cost(*columns: str) -> Column:
    """Length of an observation of these columns as JSON text, with a space after each comma and colon between fields."""
    plain = F.length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return plain + (2 * len(columns) - 1)


def trim_by_budget(conv: DataFrame, chars: int, cost: Column | None = None) -> DataFrame:
    """The newest turns of each session whose roles and texts fit the budget together, the newest always; without a budget the last 6. Another cost of a turn, such as
    observation_cost() of tool observations, takes the place of the length of role and text."""
    if chars <= 0:
        return recent_turns(conv, FALLBACK_TURNS)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cost = F.length(F.coalesce("role", F.lit(""))) + F.length(F.coalesce("text", F.lit(""))) if cost is None else cost
    rows = conv.withColumn("_sum", F.sum(cost).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(newest))
    return rows.where((F.col("_sum") <= chars) | (F.col("_n") == 1)).drop("_sum", "_n")


def classify_queries(queries: DataFrame, column: str = "query") -> DataFrame:
    return queries.withColumn("intent", X.classify_query(F.col(column)))


def infer_time_windows(queries: DataFrame, as_of: Column, column: str = "query") -> DataFrame:
    """Adds label, start_date and end_date, null where the query names no time."""
    return queries.withColumn("_w", X.infer_time_window(F.col(column), as_of)).select("*", "_w.label", "_w.start_date", "_w.end_date").drop("_w")


def rag_context(queries: DataFrame, hits: DataFrame, corpus: DataFrame, chosen: DataFrame, preview: int = 180) -> DataFrame:
    """query_id and context: the chosen articles (query_id, news_id, position), then the best 3 hits, or 10 where none is chosen; a fixed sentence without hits."""
    rows = corpus.select("news_id", F.coalesce("title", F.lit("")).alias("title"), X.format_date(F.col("publish_date")).alias("date"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("content_text", F.lit("")).alias("text"))
    picked = chosen.join(rows, "news_id").withColumn("part", F.concat(F.lit("资讯标题："), "title", F.lit("\n资讯正文："), "text", F.lit("\n资讯日期："), "date"))
    ordered = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), "\n\n")
    first = picked.groupBy("query_id").agg(ordered("position", "part").alias("chosen"))
    many = queries.select("query_id").join(first.select("query_id", F.lit(3).alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(10)).alias("n"))
    cut = F.when(F.length("text") > preview, F.concat(F.left("text", F.lit(preview)), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". 标题："), "title", F.lit("\n日期："), "date", F.lit("\n链接："), "url", F.lit("\n正文："), cut)
    found = hits.join(many, "query_id").where(F.col("rank") <= F.col("n")).join(rows, "news_id").withColumn("line", line)
    second = found.groupBy("query_id").agg(ordered("rank", "line").alias("hits"))
    joined = queries.select("query_id").join(first, "query_id", "left").join(second, "query_id", "left")
    return joined.select("query_id", F.concat_ws("\n\n", "chosen", F.coalesce("hits", F.lit(NO_HIT))).alias("context"))


def cited_sources(observations: DataFrame) -> DataFrame:
    """Per session the distinct URLs in the order in which they first occur. observations: session, pos, url."""
    first = observations.where(~X.blank(F.col("url"))).groupBy("session", "url").agg(F.min("pos").alias("pos"))
    return first.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
