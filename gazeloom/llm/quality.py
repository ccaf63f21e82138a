"""Operators 1 and 6: scores of documents by n-gram language models trained on labelled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import stage, table, tidy
from gazeloom.llm.ngram_lm import cross_entropies

#: Rows of labels (16 bytes each) up to which they are broadcast; beyond that the join is left to Spark.
BROADCAST_ROWS = 2_000_000
#: Of the trusted texts held out of training, this share is accepted in each language.
QUANTILE = 0.99
#: About one and a half standard deviations of one token's loss, in nats, and the tokens from which on a text's mean loss counts as certain (defaults of parameters). A text
#: is judged by log perplexity less MARGIN * max(0, 1 / sqrt(tokens) - 1 / sqrt(SURE_TOKENS)), the lower end of what a short text leaves certain; else a few odd short texts
#: would widen the threshold for all.
MARGIN, SURE_TOKENS = 3.0, 400
#: A language's own threshold is its median plus its spread, from the median to the quantile. Against its held-out trusted texts, the level common to all
#: languages weighs as much as LEVEL_TEXTS texts, and the common spread as much as SPREAD_TEXTS: a level is known from few texts, a high quantile isn't.
LEVEL_TEXTS, SPREAD_TEXTS = 1, 50
FOLDS = 4


def part_of_text(n: int) -> Column:
    """A number below n from the text alone, in lower case and without white space, so that copies of a text, whatever their doc_id, lie on the same side; 0 for null."""
    return F.coalesce(F.crc32(F.lower(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("binary")) % n, F.lit(0)).cast("int")


def with_flag(docs: DataFrame, labels: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """doc_id, text, the columns to keep, and flag: 1 where a label of the document is 1, 0 where labels say otherwise, null without label."""
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("flag"))
    if labels.count() <= BROADCAST_ROWS:
        flags = F.broadcast(flags)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    return plain.join(flags, "doc_id", "left")


@tidy
def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cross-entropy of each document under a target and a background model, and their difference.

    The target is the documents that labels mark with quality 1, the background all others. Both are halved by the crc32 of the text in lower case without white space, and each half trains a model of
    the same order, smoothing and vocabulary; a document is scored by the two models of the other half, so they have seen neither its text nor a copy of it that differs in
    case or white space alone, under whatever doc_id. Near copies of other wording may lie in the other half. The models are matched in all but the amount of text: the background has as much as there is.
    Returns doc_id, n_tokens, ce_target, ce_background (nats a token) and score, the mean over
    tokens of the target loss less the background loss: lower is closer to the target. Texts are taken whole. A null or empty text has no tokens and
    null scores; a null doc_id has no label; repeated rows count and are scored each, and of a doc_id with several texts each is scored by itself; other columns are not read. An empty table
    gives no rows. A half without any labelled row has a uniform target model.
    """
    rows = with_flag(docs, labels, "quality", []).withColumn("half", part_of_text(2)).select("doc_id", "text", "half", (F.when(F.col("flag") == 1, 0).otherwise(2) + F.col("half")).alias("model"))
    found = cross_entropies(rows, 4, ["half"], "difference")
    other = lambda first: F.when(F.col("half") == 0, F.col(f"loss{first + 1}")).otherwise(F.col(f"loss{first}"))
    n = F.nullif("n_tokens", F.lit(0))
    target, background = other(0) / n, other(2) / n
    return found.select("doc_id", "n_tokens", target.alias("ce_target"), background.alias("ce_background"), (target - background).alias("score"))


@tidy
def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, sure_tokens: int = SURE_TOKENS) -> DataFrame:
    """Perplexity of each document under a model of trusted text, and whether it is accepted.

    Documents that labels mark with quality 1 are trusted. Three quarters of them (by crc32 of the text in lower case without white space, so that no copy of a held-out text trains) train the model; of the others,
    the given quantile in each language of the lower bound of perplexity is that language's threshold (null lang is a language of its own), shrunk
    to what all languages have in common by weights that fall smoothly with the number of such texts in the language (see LEVEL_TEXTS): with many it
    is the language's quantile, with none the quantile over all. The bound is
    perplexity times exp(-margin * max(0, 1 / sqrt(n_tokens) - 1 / sqrt(sure_tokens))): one continuous rule for all lengths, which comes to the perplexity itself
    at sure_tokens tokens and stays there; margin 0 takes the perplexity at every length.
    Returns doc_id, lang, n_tokens, perplexity, lower_bound, threshold, accepted (lower_bound <= threshold).
    Texts are taken whole. A null or empty text has null perplexity and is not accepted. A null doc_id has no label. Repeated rows are
    scored each. Other columns are not read. Without any trusted text the threshold is null and everything with text is accepted.
    """
    trusted = F.coalesce(F.col("flag") == 1, F.lit(False))
    held_out = part_of_text(FOLDS) == 0
    rows = with_flag(docs, labels, "quality", ["lang"]).select("doc_id", "text", "lang", F.when(trusted & ~held_out, 0).alias("model"), (trusted & held_out).alias("judged"))
    found = cross_entropies(rows, 1, ["lang", "judged"], "quality")
    found = stage(found.withColumn("log_ppl", F.expr("loss0 / nullif(n_tokens, 0)")).withColumn("bound", F.col("log_ppl") - margin * F.greatest(F.lit(0.0), 1 / F.sqrt(F.nullif("n_tokens", F.lit(0))) - sure_tokens**-0.5)), "perplexities")
    judged = found.where(F.col("judged") & F.col("bound").isNotNull())
    high = lambda c: F.percentile_approx(c, quantile, 100_000)
    overall = judged.agg(high("bound")).first()[0]
    own = judged.groupBy(F.coalesce("lang", F.lit("")).alias("own_lang")).agg(high("bound").alias("own"), F.percentile_approx("bound", 0.5, 100_000).alias("median"), F.count(F.lit(1)).alias("n"))
    own = stage(own, "languages")
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    near = F.coalesce("lang", F.lit("")) == F.col("own_lang")
    spread = judged.join(own, near).agg(high(F.col("bound") - F.col("median"))).first()[0]
    found = found.join(own, near, "left")
    overall, spread = F.lit(overall).cast("double"), F.lit(spread).cast("double")
    # What the common level and spread would change; written as differences, so that a single language keeps exactly its quantile.
    wider = spread - (F.col("own") - F.col("median"))
    limit = F.coalesce(F.col("own") + (overall - F.col("own") - wider) * LEVEL_TEXTS / (F.col("n") + LEVEL_TEXTS) + wider * SPREAD_TEXTS / (F.col("n") + SPREAD_TEXTS), overall)
    return found.select(
        "doc_id",
        "lang",
        "n_tokens",
        F.exp("log_ppl").alias("perplexity"),
        F.exp("bound").alias("lower_bound"),
        F.exp(limit).alias("threshold"),
        F.coalesce(F.when(limit.isNull(), F.col("bound").isNotNull()).otherwise(F.col("bound") <= limit), F.lit(False)).alias("accepted"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents, and whether they are accepted."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
