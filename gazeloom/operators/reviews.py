"""Submissions and registrations, in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.operators.adapt import SUBMISSION_SOURCE, adapt_submission
from gazeloom.operators.dedup import partial_update

STATUSES = ("pending", "approved", "rejected")
MAX_LENGTH = 10_000


def submission_ids(drafts: DataFrame, max_length: int = MAX_LENGTH, stored: DataFrame | None = None) -> DataFrame:
    """Drafts with submission_id and size that are small enough; the first (by seq) of equal ids, and none that is stored."""
    raw = F.concat(F.coalesce("title", F.lit("")), F.coalesce("date", F.lit("")), F.coalesce("detail_url", F.lit("")))
    size = F.greatest(*[F.length(F.coalesce(c, F.lit(""))) for c in ("label", "title", "detail_url", "content_text")], F.length(F.to_json(F.coalesce("attachment_urls", F.array().cast("array<string>")))))
    rows = drafts.withColumn("submission_id", F.sha2(raw, 256)).withColumn("size", size).where(F.col("size") <= max_length)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("submission_id").orderBy("seq"))).where("_n = 1").drop("_n")
    return rows if stored is None else rows.join(stored.select("submission_id"), "submission_id", "left_anti")


def latest_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """The last decision (by seq) of each row, if its status is known."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return decisions.where(F.col("action").isin(*STATUSES)).withColumn("_n", n).where("_n = 1").drop("_n")


def apply_reviews(submissions: DataFrame, decisions: DataFrame, stored: DataFrame, max_length: int = MAX_LENGTH, accepted: tuple[str, ...] = ("success", "duplicate")) -> dict[str, DataFrame]:
    """submissions with new status and review, and the articles and notices that approved ones become.

    An approved submission counts only if its text is short enough and its ingestion ends in an accepted status; another keeps its status.
    """
    from gazeloom.operators.ingest import ingest

    decided = submissions.join(latest_decisions(decisions, "submission_id").select("submission_id", "action", F.col("review").alias("_review")), "submission_id")
    approved = decided.where((F.col("action") == "approved") & (F.length(F.coalesce("content_text", F.lit(""))) <= max_length))
    articles = adapt_submission(approved.withColumn("review", F.coalesce("_review", "review")).withColumn("status", F.lit("approved")))
    done = ingest(articles.withColumn("seq", F.xxhash64("news_id")), stored)
    passed = done["statuses"].where(F.col("status").isin(*accepted)).select(F.col("news_id").alias("submission_id")).distinct()
    updates = (
        decided.where("action <> 'approved'").select("submission_id", F.col("action").alias("status"), F.col("_review").alias("review"))
        .union(approved.join(passed, "submission_id", "left_semi").select("submission_id", F.lit("approved"), "_review"))
    )
    notices = approved.join(passed, "submission_id", "left_semi").select(
        F.col("submission_id").alias("id"), F.coalesce(F.nullif("label", F.lit("")), F.lit(SUBMISSION_SOURCE)).alias("label"), "title", "date", F.coalesce("detail_url", F.lit("")).alias("detail_url"), "is_page", "content_text", F.to_json("attachment_urls").alias("attachments")
    )
    return {"submissions": partial_update(submissions, updates, "submission_id"), "articles": done["articles"], "notices": notices}


def my_submissions(df: DataFrame, user: str) -> DataFrame:
    return df.where(F.col("submitter_id") == user)


def apply_registrations(registrations: DataFrame, decisions: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Approved registrations become users unless their name or email is taken, by a user or by an earlier one (by registration_id) of the batch; they then leave the list. Others get their status and review."""
    decided = registrations.join(latest_decisions(decisions, "registration_id").select("registration_id", "action", F.col("review").alias("_review")), "registration_id")
    free = decided.where("action = 'approved'").join(users.select("username"), "username", "left_anti").join(users.select("email"), "email", "left_anti")
    by_name, by_mail = (Window.partitionBy(c).orderBy("registration_id") for c in ("username", "email"))
    free = free.withColumn("_a", F.row_number().over(by_name)).where("_a = 1").withColumn("_b", F.row_number().over(by_mail)).where("_b = 1").drop("_a", "_b")
    moved = free.select("registration_id", "username", "email", "password_hash")
    updates = decided.where("action <> 'approved'").select("registration_id", F.col("action").alias("status"), F.col("_review").alias("review"))
    left = partial_update(registrations.join(moved.select("registration_id"), "registration_id", "left_anti").select(registrations.columns), updates, "registration_id")
    return {"users": users.select("username", "email", "password_hash").unionByName(moved.drop("registration_id")), "registrations": left, "added": moved}

