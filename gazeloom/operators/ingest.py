"""From raw articles to the stored table, with one status for every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.functions import text as X
from gazeloom.operators.adapt import normalize_records, validate_documents
from gazeloom.operators.dedup import classify_incoming, dedup_batch, near_duplicates, upsert
from gazeloom.operators.listing import project_notices
from gazeloom.operators.vectors import embed_columns, match_tags, merge_tags
from gazeloom.staging import broadcast_if_small, delete, scope, stage

#: Digits of an article's similarity to a tag: its vector has 32-bit numbers, whose rounding moves the eighth.
TAG_DIGITS = 6


def statuses(raw: DataFrame, stored: DataFrame, validate: bool = True, normalise: bool = True, dedup: bool = True, near: bool = False) -> DataFrame:
    """seq, news_id, status (success, upsert, duplicate or invalid) and message of each row of raw: articles with seq, which is unique.

    Texts are looked at once, for their faults (and with `near` for their fingerprints); what is compared, moved and staged afterwards is seq, id, URL, date and flags. Without
    dedup every valid row is a success.
    """
    rows = validate_documents(raw) if validate else raw.withColumn("is_valid", F.lit(True)).withColumn("errors", F.array().cast("array<string>"))
    date = X.normalize_datetime(F.col("publish_date")) if normalise and dict(raw.dtypes)["publish_date"] == "string" else F.col("publish_date")
    light = ["seq", "news_id", "url", date.alias("publish_date"), "is_valid", F.array_join("errors", ";").alias("errors")]
    if near:
        text = F.coalesce(F.when(~X.blank(F.col("content_text")), F.col("content_text")), X.markdown_to_text(F.col("content_markdown"))) if normalise else F.col("content_text")
        light.append(text.alias("content_text"))
    rows = stage(rows.select(*light), "faults")
    bad = rows.where(~F.col("is_valid")).select("seq", "news_id", F.lit("invalid").alias("status"), F.col("errors").alias("message"))
    good = rows.where("is_valid").drop("is_valid", "errors")
    if not dedup:
        return good.select("seq", "news_id", F.lit("success").alias("status"), F.lit("").alias("message")).unionByName(bad)
    good = dedup_batch(good)
    if near:
        good = near_duplicates(good).withColumn("is_duplicate", F.col("is_duplicate") | F.col("is_near_duplicate"))
    found = classify_incoming(good.select("seq", "news_id", "url", "publish_date", "is_duplicate"), stored)
    kind = F.when(F.col("is_duplicate"), "duplicate").when(F.col("status") == "new", "success").otherwise(F.col("status"))
    message = F.when(F.col("is_duplicate"), "repeated in the batch").when(kind == "duplicate", "already stored").otherwise("")
    return found.select("seq", "news_id", kind.alias("status"), message.alias("message")).unionByName(bad)


def ingest(
    raw: DataFrame,
    stored: DataFrame,
    *,
    near: bool = False,
    vectors: dict[str, tuple[str, int]] | None = None,
    encoder: Callable | None = None,
    tags: DataFrame | None = None,
    threshold: float | None = None,
    write: Callable[[DataFrame], None] | None = None,
    normalise: bool = True,
    **steps: bool,
) -> dict[str, DataFrame]:
    """statuses (seq, news_id, status, message for every row of raw), articles (the rows to write), table (stored with them) and notices.

    stored has the columns of the articles table in use; of several rows to write with one id the last by seq wins. vectors and tags are the steps of embedding and tag matching, left out where
    not given. write stores the table; where it fails, the rows to write have status error and the fault as message. What stays in the shared folder is what these frames read from: the statuses, and where there are vectors or tags the articles and their matches.
    """
    spark, made = raw.sparkSession, []
    with scope(made):
        found = statuses(raw, stored, normalise=normalise, near=near, **steps)
    done = stage(found, "statuses")
    delete(spark, made)
    wanted = done.where(F.col("status").isin("success", "upsert")).select("seq", "status", "message")
    articles = raw.drop("errors", "warnings", "is_valid", "status", "message").join(broadcast_if_small(wanted), "seq")
    if normalise:
        articles = normalize_records(articles)
    if vectors:
        articles = embed_columns(articles, vectors, **({"encoder": encoder} if encoder else {}))
    if vectors or tags is not None:
        articles = stage(articles, "articles")  # normalised and embedded once for tags, table and notices
    if tags is not None:
        articles = merge_tags(articles, stage(match_tags(articles, tags, digits=TAG_DIGITS, **({"threshold": threshold} if threshold is not None else {})), "tag-matches"))
    shared = [c for c in stored.columns if c in articles.columns]
    table = upsert(stored.select(shared), articles.select(*shared, "seq"), order="seq")
    notices = project_notices(articles) if {"metadata", "attachments"} <= set(articles.columns) else None
    report = done.select("news_id", "seq", "status", "message")
    if write is not None:
        try:
            write(table)
        except Exception as fault:  # noqa: BLE001  the writer is the caller's; the report names the fault
            failed = F.col("status").isin("success", "upsert")
            report = report.withColumn("message", F.when(failed, str(fault)[:500]).otherwise(F.col("message"))).withColumn("status", F.when(failed, "error").otherwise(F.col("status")))
    return {"statuses": report, "articles": articles, "table": table, "notices": notices}


def ingest_summary(statuses: DataFrame) -> DataFrame:
    """One row: rows and rows per status."""
    return statuses.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "upsert", "invalid", "duplicate", "error")])
