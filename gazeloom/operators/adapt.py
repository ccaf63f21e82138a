"""Records of crawls and submissions as articles, validated and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.functions import text as X
from gazeloom.schemas import ARTICLE, CONTENT, UNKNOWN_AUTHOR, UNKNOWN_SOURCE

#: Limits of a valid document (fixed values).
TITLE_LIMITS, CONTENT_LIMITS = (1, 500), (10, 1_000_000)
SUBMISSION_SOURCE = "用户投稿"
META = ("detail_url", "date", "label", "is_page", "success", "error")


def filled(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def present(c: Column | str) -> Column:
    """The text, or null where it is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~X.blank(c), c)


def adapt_crawl(df: DataFrame, mapping: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Crawl records of either shape as articles. A null field counts as absent.

    content_text is the text of the content where this is an object, else the content where it isn't blank, else a given content_text, else the markdown; what is found so, but blank, is null.

    mapping names further input columns and the field of a record that each one fills where it isn't null; defaults gives values for fields of the article
    that are null at the end, besides those of source and author.
    """
    for source, field in (mapping or {}).items():
        df = df.withColumn(field, F.coalesce(F.col(source), F.col(field)) if field in df.columns else F.col(source))
    defaults = {"source_site": UNKNOWN_SOURCE, "author": UNKNOWN_AUTHOR} | (defaults or {})
    out = _adapted(df)
    return out.withColumns({field: F.coalesce(F.col(field), F.lit(value).cast(dict(out.dtypes)[field])) for field, value in defaults.items()})


def _adapted(df: DataFrame) -> DataFrame:
    has = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    body = F.when(X.strip(F.col("content")).startswith("{"), F.from_json("content", CONTENT))
    words = F.coalesce(body["text"], F.when(body.isNull(), F.col("content")))
    markdown = F.coalesce(present("markdown"), present(words))
    url = F.coalesce(filled("detail_url"), filled("url"))
    title = F.coalesce(filled("title"), filled(X.first_sentence_title(markdown)))
    tags = F.filter(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.when(filled("label").isNotNull(), F.array("label")).otherwise(F.array().cast("array<string>")))), lambda t: ~X.blank(t))
    meta = F.map_concat(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in META]), F.array(*[has(n).cast("string") for n in META])), lambda _, v: v.isNotNull()))
    key = F.substring(F.md5(F.coalesce(url, title, F.lit(""))), 1, 16)
    return df.select(
        F.coalesce(filled("id"), key).alias("news_id"),
        title.alias("title"),
        url.alias("url"),
        X.normalize_datetime(F.coalesce("date", "publish_date")).alias("publish_date"),
        F.coalesce("source_site", "source").alias("source_site"),
        F.col("author"),
        tags.alias("tags"),
        markdown.alias("content_markdown"),
        present(F.coalesce(body["text"], present(F.when(body.isNull(), F.col("content"))), F.col("content_text"), F.col("markdown"))).alias("content_text"),
        F.filter(F.coalesce(body["attachment_urls"], F.col("attachments"), F.array().cast("array<string>")), lambda a: a != "").alias("attachments"),
        F.lit(1).alias("crawl_version"),
        F.to_json(meta).alias("metadata"),
        *[c for c in df.columns if c == "seq"],
    )


def adapt_submission(df: DataFrame, host: str = "submissions.invalid") -> DataFrame:
    """Submissions as articles."""
    meta = F.struct(
        F.lit("submission").alias("source"), "submission_id", "submitter_id", F.coalesce("detail_url", F.lit("")).alias("detail_url"), "is_page", "label", "review", "status"
    )
    return df.select(
        F.col("submission_id").alias("news_id"),
        "title",
        F.coalesce(filled("detail_url"), F.concat(F.lit(f"https://{host}/"), F.col("submission_id"))).alias("url"),
        X.normalize_datetime(F.col("date")).alias("publish_date"),
        F.lit(SUBMISSION_SOURCE).alias("source_site"),
        F.col("submitter_id").alias("author"),
        F.when(filled("label").isNotNull(), F.array("label")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.col("content_text").alias("content_markdown"),
        "content_text",
        F.col("attachment_urls").alias("attachments"),
        F.lit(1).alias("crawl_version"),
        F.to_json(meta).alias("metadata"),
    )


def validate_documents(df: DataFrame, domains: list[str] | None = None, required: tuple[str, ...] = ("news_id", "title", "url")) -> DataFrame:
    """Adds errors, warnings and is_valid. Content is judged where there is any: null and empty content is none."""
    scheme, host = (F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)", k) for k in (1, 2))
    given = present("url").isNotNull()
    text = F.col("content_text")
    checks = [F.when(present(c).isNull(), f"missing:{c}") for c in required]
    checks += [F.when(given & ~F.lower(scheme).isin("http", "https"), "url:scheme"), F.when(given & (host == ""), "url:host")]
    if domains:
        ok = F.lit(False)
        for d in domains:
            ok = ok | (F.lower(host) == d) | F.lower(host).endswith("." + d)
        checks.append(F.when(given & ~ok, "url:domain"))
    size = F.length("title")
    checks.append(F.when(present("title").isNotNull() & ~size.between(*TITLE_LIMITS), "title:length"))
    checks.append(F.when((text != "") & X.blank(text), "content:blank").when((text != "") & ~F.length(text).between(*CONTENT_LIMITS), "content:length"))
    warnings = [F.when(present("news_id").isNotNull() & ~F.col("news_id").rlike(r"^[a-zA-Z0-9_\-]+$"), "news_id:characters")]
    return df.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("warnings", F.array_compact(F.array(*warnings))).withColumn("is_valid", F.size("errors") == 0)


def normalize_records(df: DataFrame) -> DataFrame:
    """Whole articles in their normal form: title, date, markdown, text, attachments, version and metadata."""
    date = F.col("publish_date") if dict(df.dtypes)["publish_date"] == "timestamp" else X.normalize_datetime(F.col("publish_date"))
    kind = dict(df.dtypes)["metadata"]
    meta = F.col("metadata") if kind == "string" else F.to_json("metadata")
    return df.withColumns(
        {
            "title": F.coalesce(present("title"), X.first_sentence_title(F.col("content_markdown"))),
            "publish_date": date,
            "content_markdown": X.repair_markdown(F.coalesce("content_markdown", F.lit(""))),
            "content_text": F.coalesce(present("content_text"), X.markdown_to_text(F.col("content_markdown"))),
            "attachments": F.filter(F.coalesce("attachments", F.array().cast("array<string>")), lambda a: ~X.blank(a)),
            "crawl_version": F.coalesce("crawl_version", F.lit(1)),
            "metadata": filled(meta),
        }
    )


def to_article_schema(df: DataFrame) -> DataFrame:
    """All fields of an article with defaults; rows without an id are left out."""
    empty = F.array().cast("array<string>")
    defaults = {"source_site": F.lit(UNKNOWN_SOURCE), "author": F.lit(UNKNOWN_AUTHOR), "tags": empty, "attachments": empty, "crawl_version": F.lit(1)}
    columns = []
    for field in ARTICLE.fields:
        c = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        columns.append((F.coalesce(c, defaults[field.name]) if field.name in defaults else c).alias(field.name))
    return df.where(~X.blank(F.col("news_id"))).select(columns)


#: Fields that conditions may name (fixed values).
FILTER_FIELDS = ("news_id", "title", "url", "publish_date", "source_site", "author", "tags", "crawl_version", "last_updated")


def safe_filter(df: DataFrame, conditions: dict, op: str = "and", fields: tuple[str, ...] = FILTER_FIELDS) -> DataFrame:
    """Rows that meet conditions on named fields: null, one value, a list of values, or {'contains': text}."""
    if op.lower() not in ("and", "or"):
        raise ValueError("op is 'and' or 'or'")
    found = None
    for field, value in conditions.items():
        if field not in fields:
            raise ValueError(f"no condition may name {field!r}")
        c = F.col(field)
        if value is None:
            one = c.isNull()
        elif isinstance(value, dict):
            one = c.contains(value["contains"])
        elif isinstance(value, (list, tuple, set)):
            one = c.isin(list(value))
        else:
            one = c == value
        found = one if found is None else (found & one if op.lower() == "and" else found | one)
    return df if found is None else df.where(found)
