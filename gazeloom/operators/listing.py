"""Read models, lists and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.functions import text as X

UNKNOWN = "未知"
DATE_UNITS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def latest(df: DataFrame, n: int, offset: int = 0, oldest: bool = False) -> DataFrame:
    """The newest (or oldest) n articles by publish date, undated ones last."""
    order = F.asc_nulls_last("publish_date") if oldest else F.desc_nulls_last("publish_date")
    return df.orderBy(order, "news_id").offset(offset).limit(n) if offset else df.orderBy(order, "news_id").limit(n)


def find_articles(df: DataFrame, n: int, source: str | None = None, author: str | None = None, start=None, end=None, any_tag: list[str] | None = None) -> DataFrame:
    from gazeloom.operators.retrieval import article_filter

    return latest(article_filter(df, source, author, any_tag, start, end), n)


def count_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


def count_by_date(df: DataFrame, unit: str = "day", column: str = "publish_date") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.date_format(column, DATE_UNITS[unit]).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(df: DataFrame) -> DataFrame:
    """One row: articles, sources, articles by source (a map, null sources under UNKNOWN), first and last publish date."""
    by_source = df.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"), F.min("publish_date").alias("low"), F.max("publish_date").alias("high"))
    share = F.struct(F.coalesce("source_site", F.lit(UNKNOWN)), "n")
    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("source_site").alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(share))).alias("distribution"), F.min("low").alias("first_date"), F.max("high").alias("last_date")
    )


def count_by_category(tags: DataFrame) -> DataFrame:
    return tags.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def tags_by_category(tags: DataFrame, category: str) -> DataFrame:
    return tags.where(F.col("category") == category)


def _named(c: Column) -> Column:
    """Text that names something: neither blank nor none nor null."""
    c = X.strip(c)
    return F.when((c == "") | F.lower(c).isin("none", "null"), None).otherwise(c)


def project_notices(articles: DataFrame) -> DataFrame:
    """Articles as rows of the read model; rows without a usable id are left out. is_page is true where metadata doesn't name it, and false where it names null."""
    meta = F.from_json("metadata", "label string, detail_url string, is_page boolean, date string")
    names_null = F.coalesce(F.map_contains_key(F.from_json("metadata", "map<string,string>"), "is_page") & F.from_json("metadata", "map<string,string>")["is_page"].isNull(), F.lit(False))
    first = X.strip(F.try_element_at("tags", F.lit(1)))
    label = F.coalesce(F.nullif(first, F.lit("")), F.nullif(X.strip(meta["label"]), F.lit("")), X.strip(F.col("source_site")), F.lit(""))
    return articles.select(
        _named(F.col("news_id").cast("string")).alias("id"),
        label.alias("label"),
        F.coalesce("title", F.lit("")).alias("title"),
        X.format_date(F.col("publish_date")).alias("date"),
        F.coalesce(F.nullif(meta["detail_url"], F.lit("")), "url", F.lit("")).alias("detail_url"),
        F.coalesce(meta["is_page"], ~names_null).alias("is_page"),
        F.coalesce("content_text", F.lit("")).alias("content_text"),
        F.to_json(F.coalesce("attachments", F.array().cast("array<string>"))).alias("attachments"),
    ).where("id is not null")


def list_page(df: DataFrame, page: int, size: int, order: list[Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of the rows that meet a condition, and their number as a frame of one row."""
    rows = df if where is None else df.where(where)
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size), rows.agg(F.count(F.lit(1)).alias("total"))


def notice_page(notices: DataFrame, page: int, size: int, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    order = [F.desc("date"), *([F.desc("updated_at")] if "updated_at" in notices.columns else []), F.desc("id")]
    return list_page(notices, page, min(50, size), order, None if label is None else F.col("label") == label)


def labels(df: DataFrame) -> DataFrame:
    return df.where(~X.blank(F.col("label"))).select("label").distinct().orderBy("label")


def label_count(df: DataFrame) -> DataFrame:
    return df.where(~X.blank(F.col("label"))).agg(F.countDistinct("label").alias("n"))


def dashboard(notices: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: notices, active keys, calls of all keys. keys: is_active, total_requests."""
    one = notices.agg(F.count(F.lit(1)).alias("total_notices"))
    two = keys.agg(F.count_if("is_active").alias("active_keys"), F.coalesce(F.sum("total_requests"), F.lit(0)).alias("total_calls"))
    return one.crossJoin(two)  # one row each
