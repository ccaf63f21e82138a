"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

TITLE_WIDTH, CONTENT_WIDTH = 384, 1024

#: One record of a crawl file, in the superset of both shapes. content is plain text or the text of an object.
CRAWL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "label", "title", "date", "detail_url", "url", "publish_date", "author", "content", "markdown", "content_text", "source", "source_site", "error")]
    + [T.StructField("is_page", T.BooleanType()), T.StructField("success", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("attachments", T.ArrayType(T.StringType())), T.StructField("metadata", T.StringType())]
)
CONTENT = "text string, attachment_urls array<string>"

ARTICLE = T.StructType(
    [
        T.StructField("news_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("publish_date", T.TimestampType()),
        T.StructField("source_site", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("content_markdown", T.StringType()),
        T.StructField("content_text", T.StringType()),
        T.StructField("attachments", T.ArrayType(T.StringType())),
        T.StructField("title_embedding", T.ArrayType(T.FloatType())),
        T.StructField("content_embedding", T.ArrayType(T.FloatType())),
        T.StructField("crawl_version", T.IntegerType()),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
    ]
)
UNKNOWN_SOURCE, UNKNOWN_AUTHOR = "未知来源", "未知作者"
