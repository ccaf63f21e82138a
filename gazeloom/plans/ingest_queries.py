"""Queries of adaptation, validation, normalisation, duplicates, merging and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeloom.functions import text as X
from gazeloom.operators import adapt as A
from gazeloom.operators import dedup as D
from gazeloom.operators import ingest as I
from gazeloom.operators.vectors import embed_tags
from gazeloom.plans.views import ARTICLES, INCOMING, STATUS, articles, incoming, norm_url_sql, strip_sql, table, vector_sql, words_sql
from gazeloom.sources.crawl import append_articles, read_crawl_json, write_articles_json
from gazeloom.staging import new_path

W = "regexp_replace({}, '\\s+', ' ', 'g')"


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def crawled(spark, sf):
    """Whole documents written as crawl files, one array of records each, and read back through the adapter."""
    d = table(spark, sf, "documents")
    record = F.to_json(F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.left("text", F.lit(40)).alias("title"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("detail_url"), F.col("source").alias("label"), F.struct("text").alias("content")))
    path = new_path(spark, "crawl")
    d.select(record.alias("r"), F.expr("doc_id div 50").alias("g")).groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return A.adapt_crawl(read_crawl_json(spark, path))


def read_crawl(spark, sf):
    return crawled(spark, sf).select("news_id", "url", F.element_at("tags", 1).alias("tag"), F.length("content_text").cast("long").alias("n"), F.md5("content_text").alias("text_md5"), "title")


def articles_json(spark, sf):
    path = new_path(spark, "articles-json")
    write_articles_json(articles(spark, sf).select("news_id", "publish_date", "tags"), path)
    return spark.read.schema("news_id string, publish_date string, tags array<string>").json(path).select("news_id", F.left("publish_date", F.lit(10)).alias("day"), F.array_join("tags", ",").alias("tags"))


def appended(spark, sf):
    path = new_path(spark, "articles")
    rows = articles(spark, sf).drop("tags", "author")
    append_articles(rows.where("doc_id % 2 = 0"), path)
    append_articles(rows.where("doc_id % 2 = 1").withColumn("news_id", F.when(F.col("doc_id") % 9 != 0, F.col("news_id"))), path)
    return spark.read.parquet(path).select("news_id", "author", F.size("tags").alias("n_tags"), "crawl_version")


def crawl_records(spark, sf):
    """Documents as crawl records of both shapes; some have empty or blank content, with markdown or without, or content without text beside a given text."""
    n = F.col("doc_id")
    odd = n % 2 == 1
    url = F.concat(F.lit("http://h/"), n.cast("string"))
    text = F.when(n % 18 == 1, "  ").when(n % 24 == 9, None).otherwise(F.col("text"))
    flat = F.when(n % 16 == 0, "").when(n % 16 == 4, " \n ").otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        F.when(n % 3 == 0, F.concat(F.lit("id"), n.cast("string"))).alias("id"), F.when(n % 4 == 0, F.col("source")).alias("label"), F.when(n % 6 != 0, F.left("text", F.lit(30))).alias("title"),
        F.when(odd, "2024年3月5日").alias("date"), F.when(odd, url).alias("detail_url"), F.when(~odd, url).alias("url"), F.when(~odd, "2024-02-01 10:30").alias("publish_date"), F.when(n % 5 != 0, F.col("lang")).alias("author"),
        F.when(odd, F.to_json(F.struct(text.alias("text"), F.array(F.lit("a.pdf"), F.lit("")).alias("attachment_urls")))).otherwise(flat).alias("content"), F.when((n % 8 == 0) | (n % 36 == 1), F.lit("# Head\nbody")).alias("markdown"), F.when(n % 24 == 9, "given").alias("content_text"),
        F.when(n % 7 != 0, F.col("source")).alias("source"), F.lit(None).cast("string").alias("source_site"), F.lit(None).cast("string").alias("error"), odd.alias("is_page"), F.lit(None).cast("boolean").alias("success"), F.array("lang", "lang").alias("tags"), F.lit(None).cast("array<string>").alias("attachments"), F.lit(None).cast("string").alias("metadata"),
    )


def adapt_crawl(spark, sf):
    a = A.adapt_crawl(crawl_records(spark, sf))
    return a.select("news_id", "title", "url", F.date_format("publish_date", "yyyy-MM-dd HH:mm").alias("at"), "source_site", "author", F.array_join("tags", ",").alias("tags"), F.md5("content_markdown").alias("markdown_md5"), F.md5("content_text").alias("text_md5"), F.array_join("attachments", ",").alias("attachments"), F.get_json_object("metadata", "$.label").alias("label"), F.get_json_object("metadata", "$.is_page").alias("is_page"))


def submissions(spark, sf):
    """Documents as submissions; some are repeated, some long."""
    n = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("label"), F.left("text", F.lit(25)).alias("title"), F.lit("2024-04-05").alias("date"), F.when(n % 3 == 0, F.concat(F.lit("http://s/"), (n % 50).cast("string"))).alias("detail_url"), (n % 2 == 0).alias("is_page"),
        F.col("text").alias("content_text"), F.array().cast("array<string>").alias("attachment_urls"), F.concat(F.lit("u"), (n % 20).cast("string")).alias("submitter_id"), n.alias("seq"),
        F.lit("").alias("review"), F.lit("pending").alias("status"),
    )
    return rows


def adapt_submission(spark, sf):
    rows = submissions(spark, sf).withColumn("submission_id", F.concat(F.lit("s"), F.col("seq").cast("string")))
    return A.adapt_submission(rows).select("news_id", "url", _day("publish_date").alias("day"), "source_site", "author", F.array_join("tags", ",").alias("tags"), F.get_json_object("metadata", "$.status").alias("status"))


def dirty(spark, sf):
    """Articles with faults of every kind."""
    n = F.col("doc_id")
    return articles(spark, sf).withColumns(
        {
            "news_id": F.when(n % 19 == 0, "\t\n").when(n % 13 == 0, F.concat("news_id", F.lit("!"))).otherwise(F.col("news_id")),
            "url": F.when(n % 11 == 0, F.concat(F.lit("ftp://h/"), n.cast("string"))).when(n % 7 == 0, "nohost").otherwise(F.col("url")),
            "content_text": F.when(n % 10 == 0, "").when(n % 5 == 0, "short").when(n % 29 == 0, "\n" * 20 + "\t ").otherwise(F.col("content_text")),
            "title": F.when(n % 31 == 0, " \n\t").otherwise(F.col("title")),
        }
    )


def validate(spark, sf):
    rows = A.validate_documents(dirty(spark, sf), ["example.com"])
    return rows.select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")


VALIDATE_SQL = f"""WITH {ARTICLES}, dirty AS (
  SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN ' ' || chr(10) || chr(9) ELSE title END AS title, CASE WHEN doc_id % 19 = 0 THEN chr(9) || chr(10) WHEN doc_id % 13 = 0 THEN news_id || '!' ELSE news_id END AS news_id,
    CASE WHEN doc_id % 11 = 0 THEN 'ftp://h/' || doc_id WHEN doc_id % 7 = 0 THEN 'nohost' ELSE url END AS url,
    CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 5 = 0 THEN 'short' WHEN doc_id % 29 = 0 THEN repeat(chr(10), 20) || chr(9) || ' ' ELSE content_text END AS content_text FROM articles
), checked AS (
  SELECT doc_id, news_id, list_filter([CASE WHEN {strip_sql('news_id')} = '' THEN 'missing:news_id' END, CASE WHEN {strip_sql('title')} = '' OR title IS NULL THEN 'missing:title' END,
    CASE WHEN url LIKE 'ftp%' OR url = 'nohost' THEN 'url:scheme' END, CASE WHEN url = 'nohost' THEN 'url:host' END, CASE WHEN url LIKE 'ftp%' OR url = 'nohost' THEN 'url:domain' END,
    CASE WHEN content_text = '' THEN NULL WHEN {strip_sql('content_text')} = '' THEN 'content:blank' WHEN length(content_text) NOT BETWEEN 10 AND 1000000 THEN 'content:length' END], lambda x: x IS NOT NULL) AS e FROM dirty)
SELECT doc_id, array_to_string(e, ',') AS errors, CASE WHEN {strip_sql('news_id')} <> '' AND NOT regexp_matches(news_id, '^[a-zA-Z0-9_\\-]+$') THEN 'news_id:characters' ELSE '' END AS warnings, len(e) = 0 AS is_valid FROM checked"""


def normalize_dates(spark, sf):
    n = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    text = (
        F.when(n % 7 == 0, F.date_format(d, "yyyy年M月d日")).when(n % 7 == 1, F.date_format(d, "yyyy/MM/dd HH:mm")).when(n % 7 == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:20:30+08:00")))
        .when(n % 7 == 3, F.date_format(d, "dd/MM/yyyy")).when(n % 7 == 4, F.concat(F.date_format(d, "yyyy年M月d日"), F.lit(" 9时5分"))).when(n % 7 == 5, F.date_format(d, "yyyy-M-d")).otherwise("soon")
    )
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(X.normalize_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


DATES_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE) + CASE o_orderkey % 7 WHEN 2 THEN INTERVAL 8430 SECOND WHEN 4 THEN INTERVAL 32700 SECOND ELSE INTERVAL 0 SECOND END, '%Y-%m-%d %H:%M:%S') END AS at FROM orders"""


def dates(spark, sf):
    a = articles(spark, sf)
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.concat(_day("publish_date"), F.lit("T01:02"))).otherwise("May 1")
    return a.select("doc_id", X.format_date(F.col("publish_date")).alias("day"), X.safe_date(text).alias("safe"))


DATES2_SQL = f"""WITH {ARTICLES} SELECT doc_id, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS day, CASE WHEN doc_id % 3 = 2 THEN 'May 1' WHEN doc_id % 3 = 1 AND publish_date IS NOT NULL THEN strftime(publish_date, '%Y-%m-%d') ELSE '' END AS safe FROM articles"""


def clean(spark, sf):
    raw = F.concat(F.lit(" \r\n&amp; "), F.regexp_replace("text", "\n", "\r\n"), F.lit("  &lt;x&gt; "))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_text(raw)).alias("clean_md5"), X.clean_text(raw, 50).alias("cut"))


#: Entities decoded by the SQL, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def decoded_sql(c: str) -> str:
    for entity, text in ENTITIES:
        c = f"replace({c}, '{entity}', '{text}')"
    return c


CLEAN_SQL = f"""WITH t AS (SELECT doc_id, {strip_sql("regexp_replace(" + decoded_sql("' &amp; ' || replace(nfc_normalize(text), chr(13), chr(10)) || ' &lt;x&gt; '") + ", '[\\s\u00a0]+', ' ', 'g')")} AS c FROM documents)
SELECT doc_id, md5(c) AS clean_md5, CASE WHEN length(c) > 50 THEN left(c, 47) || '...' ELSE c END AS cut FROM t"""

HEAD = "# Head\n\n![img](u.png) [word](http://l) **bold** `code`\n> quote\n- item\n1. one\n---\n"


def markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.markdown_to_text(F.concat(F.lit(HEAD), "text"))).alias("text_md5"))


def text_sql(c: str) -> str:
    """markdown_to_text of an expression, by DuckDB's own expressions."""
    for pattern, to in X.MARKDOWN_MARKS:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


MARKDOWN_SQL = f"SELECT doc_id, md5({text_sql(f"'{HEAD}' || text")}) AS text_md5 FROM documents"


def repaired(spark, sf):
    """Whole texts, marks and all, behind lines with faults of every kind."""
    md = F.concat(F.lit("a**  **b\nc****d\nx | y\n-|-\n---\n\n**bold**|\n![](a)x[l](b)\n"), "text", F.lit("\n| | | | |\nend **x**"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.repair_markdown(md)).alias("repaired_md5"))


#: White space within a class of a pattern; and at the end of a line.
BLANK = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}"
REPAIRED_SQL = f"""WITH t AS (SELECT doc_id, 'a**  **b' || chr(10) || 'c****d' || chr(10) || 'x | y' || chr(10) || '-|-' || chr(10) || '---' || chr(10) || chr(10) || '**bold**|' || chr(10) || '![](a)x[l](b)' || chr(10) || text || chr(10) || '| | | | |' || chr(10) || 'end **x**' AS t FROM documents),
-- Pairs of stars around nothing, and longer runs of stars, go; then bold cells, bold at the end, and runs of bars.
stars AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*[ \\t\\r\\n]*\\*\\*', '', 'g'), '!\\[\\]([^\\[\\n]*)\\[', '![]\\1 [', 'g'), '\\*{{4,}}', '', 'g') AS t FROM t),
bars AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*([^*]+)\\*\\*\\|', '\\1|', 'g'), '\\*\\*([^*]+)\\*\\*([{BLANK}]*)\\z', '\\1\\2', 'g'), '(?:\\|[{BLANK}]*){{4,}}', '', 'g') AS t FROM stars),
ls AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: CASE WHEN contains(x, '|') AND contains(x, '-') THEN CASE WHEN starts_with(x, '|') THEN '' ELSE '|' END || CASE WHEN ends_with(regexp_replace(x, '[{BLANK}]+$', ''), '|') THEN x ELSE regexp_replace(x, '[{BLANK}]+$', '') || '|' END ELSE x END) AS ls FROM bars),
bare AS (SELECT doc_id, ls, list_transform(ls, lambda x: NOT regexp_matches(x, '[^-:{BLANK}]')) AS bare FROM ls),
kept AS (SELECT doc_id, list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT bare[i] OR i = 1 OR NOT bare[i - 1]), lambda i: CASE WHEN bare[i] THEN '' ELSE ls[i] END) AS ls FROM bare),
kinds AS (SELECT doc_id, ls, list_transform(ls, lambda x: CASE WHEN {strip_sql("x")} = '' OR starts_with({strip_sql("x")}, '![') OR starts_with({strip_sql("x")}, '|') THEN 'break'
  WHEN (contains(x, '|') AND regexp_matches({strip_sql("x")}, '[^\\s|:-]')) OR starts_with({strip_sql("x")}, '#') OR starts_with({strip_sql("x")}, '- [') OR starts_with({strip_sql("x")}, '```') THEN 'flow' ELSE 'text' END) AS kinds FROM kept)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i > 1 AND kinds[i] = 'text' AND kinds[i - 1] <> 'break' THEN chr(10) ELSE '' END || ls[i]), chr(10))) AS repaired_md5 FROM kinds"""


def titles(spark, sf):
    """Titles of whole texts, marks and all; every third has a heading below its first line."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x\n## Head **of** it \n"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.first_sentence_title(t).alias("title"))


def title_sql(c: str) -> str:
    """first_sentence_title of an expression."""
    head, sentence = text_sql(f"regexp_extract({c}, '(?m)^#+\\s*(\\S.*?)$', 1)"), f"trim(regexp_extract({text_sql(c)}, '^[^。！？?!.…]*[。！？?!.…]*'))"
    cuts = " ".join(f"WHEN contains(left({sentence}, 100), '{d}') THEN regexp_extract(left({sentence}, 100), '^(?s:.*[{d}])')" for d in X.CUTS)
    return f"CASE WHEN length({head}) > 100 THEN left({head}, 97) || '...' WHEN {head} <> '' THEN {head} WHEN length({sentence}) <= 100 THEN {sentence} {cuts} ELSE left({sentence}, 100) || '...' END"


TITLES_SQL = f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || '## Head **of** it ' || chr(10) || text ELSE text END AS t FROM documents)
SELECT doc_id, {title_sql("t")} AS title FROM t"""


ADAPT_SQL = f"""WITH r AS (SELECT *, CASE WHEN doc_id % 8 = 0 OR doc_id % 36 = 1 THEN '# Head' || chr(10) || 'body' END AS markdown,
  -- Content that names a text has that one, blank or not; other content counts where it isn't blank.
  CASE WHEN doc_id % 24 = 9 OR doc_id % 18 = 1 OR doc_id % 16 IN (0, 4) OR {strip_sql("text")} = '' THEN NULL ELSE text END AS words FROM documents),
a AS (SELECT *, coalesce(markdown, words) AS md, CASE WHEN doc_id % 24 = 9 THEN 'given' WHEN doc_id % 18 = 1 OR (doc_id % 2 = 1 AND words IS NULL) THEN NULL ELSE coalesce(words, markdown) END AS body FROM r)
SELECT CASE WHEN doc_id % 3 = 0 THEN 'id' || doc_id ELSE left(md5('http://h/' || doc_id), 16) END AS news_id,
  nullif(CASE WHEN doc_id % 6 <> 0 AND text <> '' THEN left(text, 30) WHEN markdown IS NOT NULL THEN 'Head' ELSE {title_sql("coalesce(md, '')")} END, '') AS title, 'http://h/' || doc_id AS url,
  CASE WHEN doc_id % 2 = 1 THEN '2024-03-05 00:00' ELSE '2024-02-01 10:30' END AS at, CASE WHEN doc_id % 7 <> 0 THEN source ELSE '未知来源' END AS source_site, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE '未知作者' END AS author,
  CASE WHEN doc_id % 4 = 0 THEN lang || ',' || source ELSE lang END AS tags, md5(md) AS markdown_md5, md5(body) AS text_md5,
  CASE WHEN doc_id % 2 = 1 THEN 'a.pdf' ELSE '' END AS attachments, CASE WHEN doc_id % 4 = 0 THEN source END AS label, CASE WHEN doc_id % 2 = 1 THEN 'true' ELSE 'false' END AS is_page
FROM a"""


def content_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.title_from_content(F.col("text")).alias("title"), X.date_from_content(F.col("text")).alias("date"))


CONTENT_SQL = f"""WITH t AS (SELECT doc_id, text, list_transform(string_split({strip_sql("text")}, chr(10)), lambda x: {strip_sql("x")}) AS ls, {strip_sql("regexp_extract(text, '^[^。.]*')")} AS first FROM documents),
c AS (SELECT *, list_concat(
    list_transform(ls[1:5], lambda x: coalesce(CASE WHEN length({strip_sql("regexp_extract(x, '【[^】]+】(.+)', 1)")}) > 2 THEN {strip_sql("regexp_extract(x, '【[^】]+】(.+)', 1)")} END, CASE WHEN length({strip_sql("regexp_extract(x, '【(.+)】', 1)")}) > 3 THEN {strip_sql("regexp_extract(x, '【(.+)】', 1)")} END)),
    list_transform(ls[1:3], lambda x: CASE WHEN starts_with(x, '#') AND length({strip_sql("regexp_replace(x, '^#+', '')")}) > 2 THEN {strip_sql("regexp_replace(x, '^#+', '')")} END)) AS found FROM t)
SELECT doc_id, coalesce(list_filter(found, lambda x: x IS NOT NULL)[1], CASE WHEN first = '' OR starts_with(first, '![') THEN '' WHEN length(first) > 100 THEN left(first, 100) || '...' ELSE first END) AS title,
  coalesce(regexp_extract(text, '([0-9]{{1,2}}年)?[0-9]{{1,2}}月[0-9]{{1,2}}[日号]'), '') AS date FROM c"""


def normalized_rows(spark, sf):
    """Normal forms of all articles; those of odd doc_id have no text but their markdown's."""
    return A.normalize_records(articles(spark, sf).withColumn("content_text", F.when(F.col("doc_id") % 2 == 0, F.col("content_text"))).withColumn("crawl_version", F.when(F.col("doc_id") % 4 != 0, F.col("crawl_version"))))


def normalized(spark, sf):
    return normalized_rows(spark, sf).select("news_id", "title", _day("publish_date").alias("day"), F.md5("content_text").alias("text_md5"), "crawl_version", "metadata")


NORMALIZED_SQL = f"""WITH {ARTICLES} SELECT news_id, CASE WHEN {strip_sql('title')} <> '' THEN title ELSE '' END AS title, strftime(publish_date, '%Y-%m-%d') AS day, md5(CASE WHEN doc_id % 2 = 0 AND {strip_sql('content_text')} <> '' THEN content_text ELSE {text_sql('content_text')} END) AS text_md5, CASE WHEN doc_id % 4 <> 0 THEN crawl_version ELSE 1 END AS crawl_version,
  CASE WHEN doc_id % 5 = 0 THEN '{{"label":"' || meta_label || '","detail_url":"' || meta_url || '","is_page":false}}' WHEN doc_id % 5 = 1 THEN '{{bad' END AS metadata FROM articles"""


def urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.normalize_url(F.col("url")).alias("nurl"), X.url_hash(F.col("url")).alias("url_hash"))


def filtered(spark, sf):
    a = articles(spark, sf)
    return A.safe_filter(a, {"source_site": ["src1", "src2"], "author": "en", "title": {"contains": "th"}}).select("news_id").union(A.safe_filter(a, {"publish_date": None, "crawl_version": 3}, "and").select("news_id"))


def dedup(spark, sf):
    return D.dedup_batch(incoming(spark, sf)).select("seq", "url_hash", "is_duplicate")


def fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.simhash("text").alias("simhash"))


SIMHASH_SQL = """WITH t AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+')) AS t FROM documents),
c AS (SELECT doc_id, CAST('0x' || right(md5(t), 16) AS UBIGINT) AS h, count(*) AS n FROM t WHERE length(t) >= 2 GROUP BY ALL),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> CAST(i AS UBIGINT)) & CAST(1 AS UBIGINT) = 1 THEN n ELSE -n END) AS v FROM c, range(64) r(i) GROUP BY ALL),
s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END) AS u FROM b GROUP BY ALL)
SELECT d.doc_id, CAST(CASE WHEN coalesce(u, 0) >= CAST(9223372036854775808 AS HUGEINT) THEN u - CAST(9223372036854775808 AS HUGEINT) - CAST(9223372036854775808 AS HUGEINT) ELSE coalesce(u, 0) END AS BIGINT) AS simhash FROM documents d LEFT JOIN s USING (doc_id)"""


def hamming(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.hamming(F.col("event_id"), F.col("user_id")).alias("bits"))


def near(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content_text"))
    return D.near_duplicates(rows).select("seq", "simhash", "is_near_duplicate")


#: Rows one after the other, in order of doc_id, against the fingerprints kept so far.
NEAR_SQL = SIMHASH_SQL.replace("SELECT d.doc_id, CAST(", ", f AS MATERIALIZED (SELECT d.doc_id, text, CAST(").replace("AS simhash FROM documents d LEFT JOIN s USING (doc_id)", f"""AS simhash FROM documents d LEFT JOIN s USING (doc_id)),
r AS MATERIALIZED (SELECT simhash, min(doc_id) AS doc_id, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS n FROM f WHERE {strip_sql("text")} <> '' GROUP BY simhash),
g(n, kept, near) AS (SELECT 0, CAST([] AS BIGINT[]), false UNION ALL SELECT r.n, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, simhash)) <= 3)) > 0 THEN kept ELSE list_append(kept, simhash) END, len(list_filter(kept, lambda k: bit_count(xor(k, simhash)) <= 3)) > 0 FROM g JOIN r ON r.n = g.n + 1)
SELECT f.doc_id AS seq, f.simhash, coalesce({strip_sql("text")} <> '' AND (g.near OR f.doc_id > r.doc_id), false) AS is_near_duplicate FROM f LEFT JOIN r USING (simhash) LEFT JOIN g USING (n)""").replace("WITH t AS", "WITH RECURSIVE t AS", 1)


def classified(spark, sf):
    return D.classify_incoming(incoming(spark, sf), articles(spark, sf)).select("seq", "news_id", "status")


def upserted(spark, sf):
    a = articles(spark, sf).select("news_id", "url", "crawl_version")
    new = incoming(spark, sf).where("doc_id % 10 >= 6").select("news_id", "url", "crawl_version", "seq")
    return D.upsert(a, new, order="seq", bump=True)


def updated(spark, sf):
    a = articles(spark, sf).select("news_id", "url", "crawl_version")
    new = incoming(spark, sf).where("doc_id % 10 >= 8").select("news_id", "url", "crawl_version", "seq")
    return D.upsert(a, new, mode="update", order="seq")


UPSERT_SQL = f"""WITH {ARTICLES}, {INCOMING}, u AS (SELECT news_id, url, crawl_version FROM (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY seq DESC) AS n FROM incoming WHERE doc_id % 10 >= %d) WHERE n = 1)
SELECT news_id, url, crawl_version FROM articles WHERE news_id NOT IN (SELECT news_id FROM u) UNION ALL SELECT news_id, url, crawl_version%s FROM u %s"""


def partial(spark, sf):
    a = articles(spark, sf).select("news_id", "title", "author")
    new = a.where(F.expr("substr(news_id, 5)").cast("long") % 3 == 0).select("news_id", F.concat(F.lit("new "), "author").alias("author"), F.lit(None).cast("string").alias("title"))
    return D.partial_update(a, new)


def deleted(spark, sf):
    a = articles(spark, sf).select("news_id", "doc_id")
    return D.delete_ids(a, a.where("doc_id % 4 = 1")).select("news_id")


def known_urls(spark, sf):
    return D.existing_urls(incoming(spark, sf), articles(spark, sf).withColumn("url", F.concat(F.upper("url"), F.lit("/")))).select("seq", "news_id")


def by_ids(spark, sf):
    a = articles(spark, sf).select("news_id", "title")
    ids = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), (F.col("doc_id") * 2).cast("string")).alias("news_id"), F.col("doc_id").alias("position"))
    return D.fetch_by_ids(a, ids)


def ingested(spark, sf):
    """The statuses of a batch against the stored articles, all steps."""
    return I.statuses(incoming(spark, sf).drop("doc_id"), articles(spark, sf))


def statuses(spark, sf):
    return ingested(spark, sf).select("seq", "news_id", "status")


def summary(spark, sf):
    return I.ingest_summary(ingested(spark, sf))


def source_tags(spark, sf):
    """A tag for each source, named by a text of it, so that their number grows with the table's sources; embedded by their names."""
    named = table(spark, sf, "documents").where(F.length("text") > 0).groupBy("source").agg(F.min(F.struct("doc_id", F.left("text", F.lit(400)).alias("text"))).alias("m"))
    tags = named.select(F.concat(F.lit("tag_"), "source").alias("tag_id"), F.col("m.text").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("category"))
    return embed_tags(tags, width=64)


def ingest_all(spark, sf):
    """Every step at once: faults, duplicates, near-duplicates, vectors, tags, and a writer that fails; all statuses, and the rows to write with their tags."""
    raw, stored = incoming(spark, sf).drop("doc_id"), articles(spark, sf).drop("doc_id")

    def broken(table):
        raise OSError("no room")

    done = I.ingest(raw, stored, near=True, vectors={"content_embedding": ("content_text", 64)}, tags=source_tags(spark, sf), threshold=0.5, write=broken)
    rows = done["statuses"].join(done["articles"].select("seq", F.array_join(F.array_sort("tags"), ",").alias("tags")), "seq", "left")
    return rows.select("seq", "news_id", "status", F.when(F.col("status") == "error", F.col("message")).otherwise("").alias("fault"), "tags")


def ingest_near(spark, sf):
    """Statuses where near-duplicates within the batch count as duplicates."""
    return I.statuses(incoming(spark, sf).drop("doc_id"), articles(spark, sf), near=True).select("seq", "status")


def ingest_table(spark, sf):
    a = articles(spark, sf).drop("doc_id")
    done = I.ingest(incoming(spark, sf).drop("doc_id"), a)
    return done["table"].select("news_id", "url", _day("publish_date").alias("day"))


INGEST = f"""WITH {ARTICLES}, {INCOMING}, {STATUS}, titled AS (
  SELECT *, CASE WHEN {strip_sql("coalesce(title, '')")} = '' OR length(content_text) NOT BETWEEN 10 AND 1000000 OR {strip_sql('content_text')} = '' THEN 'invalid' END AS bad FROM checked
), valid AS (SELECT seq, seq > min(seq) OVER (PARTITION BY nurl) AS dup FROM titled WHERE bad IS NULL),
final AS (SELECT t.*, CASE WHEN bad IS NOT NULL THEN 'invalid' WHEN v.dup THEN 'duplicate' WHEN kind = 'new' THEN 'success' ELSE kind END AS status FROM titled t LEFT JOIN valid v USING (seq))"""

#: Near-duplicates among the valid rows, by the rule of NEAR_SQL, and the statuses with them.
NEAR_ROWS, NEAR_LAST = NEAR_SQL.removeprefix("WITH RECURSIVE ").replace("FROM documents", "FROM near_in").rsplit("\nSELECT f.doc_id", 1)
INGEST_NEAR = f"""{INGEST.replace("WITH ", "WITH RECURSIVE ", 1)}, near_in AS (SELECT seq AS doc_id, content_text AS text FROM titled WHERE bad IS NULL), {NEAR_ROWS}, near_found AS (SELECT f.doc_id{NEAR_LAST}),
near_final AS (SELECT t.* EXCLUDE (status), CASE WHEN status IN ('success', 'upsert', 'duplicate') AND is_near_duplicate THEN 'duplicate' ELSE status END AS status FROM final t LEFT JOIN near_found USING (seq))"""


def stored_sql(vectors: str) -> str:
    """Rows of vector_sql as they are stored: normalised, in 32-bit numbers."""
    return f"SELECT id, i, CAST(CAST(x AS FLOAT) / nullif(CAST(sqrt(sum(x * x) OVER (PARTITION BY id)) AS FLOAT), 0) AS DOUBLE) AS x FROM ({vectors})"


INGEST_ALL_SQL = f"""{INGEST_NEAR}, named AS (SELECT source, arg_min(left(text, 400), doc_id) || ': ' AS text FROM documents WHERE length(text) > 0 GROUP BY source),
dw AS (SELECT seq AS id, {words_sql("content_text")} AS w FROM near_final WHERE status IN ('success', 'upsert')), tw AS (SELECT 'tag_' || source AS id, {words_sql("text")} AS w FROM named),
dv AS ({stored_sql(vector_sql("dw", 64))}), tv AS ({stored_sql(vector_sql("tw", 64))}),
dl AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY id), tl AS (SELECT id, sqrt(sum(x * x)) AS n FROM tv GROUP BY id),
like_tags AS (SELECT d.id AS seq, t.id AS tag_id, round(sum(d.x * t.x) / any_value(dl.n) / any_value(tl.n), 6) AS s FROM dv d JOIN tv t USING (i) JOIN dl ON dl.id = d.id JOIN tl ON tl.id = t.id GROUP BY ALL),
m AS (SELECT seq, tag_id, row_number() OVER (PARTITION BY seq ORDER BY s DESC, tag_id) AS rank FROM like_tags WHERE s >= 0.5), own_tags AS (SELECT seq, list(tag_id ORDER BY rank) AS t FROM m WHERE rank <= 5 GROUP BY seq)
SELECT f.seq, f.news_id, CASE WHEN f.status IN ('success', 'upsert') THEN 'error' ELSE f.status END AS status, CASE WHEN f.status IN ('success', 'upsert') THEN 'no room' ELSE '' END AS fault, CASE WHEN f.status IN ('success', 'upsert') THEN array_to_string(list_sort(list_concat(f.tags, coalesce(o.t, []))), chr(44)) END AS tags FROM near_final f LEFT JOIN own_tags o USING (seq)"""

QUERIES = {
    "read_crawl_json": read_crawl, "write_articles_json": articles_json, "append_articles": appended, "adapt_crawl": adapt_crawl, "adapt_submission": adapt_submission, "validate_documents": validate,
    "normalize_datetime": normalize_dates, "format_date": dates, "clean_text": clean, "markdown_to_text": markdown, "repair_markdown": repaired, "first_sentence_title": titles, "title_from_content": content_titles,
    "normalize_records": normalized, "normalize_url": urls, "safe_filter": filtered, "dedup_batch": dedup, "simhash": fingerprints, "hamming": hamming, "near_duplicates": near, "classify_incoming": classified,
    "upsert": upserted, "upsert_update_only": updated, "partial_update": partial, "delete_ids": deleted, "existing_urls": known_urls, "fetch_by_ids": by_ids, "ingest_statuses": statuses, "ingest_summary": summary, "ingest_table": ingest_table, "ingest_all": ingest_all, "ingest_near": ingest_near,
}

ORACLE_SQL = {
    "read_crawl_json": "SELECT 'c' || doc_id AS news_id, 'http://x/' || doc_id AS url, source AS tag, CAST(length(text) AS BIGINT) AS n, md5(text) AS text_md5, left(text, 40) AS title FROM documents",
    "repair_markdown": REPAIRED_SQL,
    "near_duplicates": NEAR_SQL,
    "ingest_all": INGEST_ALL_SQL,
    "ingest_near": f"{INGEST_NEAR} SELECT seq, status FROM near_final",
    "write_articles_json": f"WITH {ARTICLES} SELECT news_id, strftime(publish_date, '%Y-%m-%d') AS day, array_to_string(tags, ',') AS tags FROM articles",
    "append_articles": f"WITH {ARTICLES} SELECT news_id, '未知作者' AS author, CAST(0 AS INTEGER) AS n_tags, crawl_version FROM articles WHERE doc_id % 2 = 0 OR doc_id % 9 <> 0",
    "adapt_crawl": ADAPT_SQL,
    "adapt_submission": "SELECT 's' || doc_id AS news_id, CASE WHEN doc_id % 3 = 0 THEN 'http://s/' || (doc_id % 50) ELSE 'https://submissions.invalid/s' || doc_id END AS url, '2024-04-05' AS day, '用户投稿' AS source_site, 'u' || (doc_id % 20) AS author, source AS tags, 'pending' AS status FROM documents",
    "validate_documents": VALIDATE_SQL,
    "normalize_datetime": DATES_SQL,
    "format_date": DATES2_SQL,
    "clean_text": CLEAN_SQL,
    "markdown_to_text": MARKDOWN_SQL,
    "first_sentence_title": TITLES_SQL,
    "title_from_content": CONTENT_SQL,
    "normalize_records": NORMALIZED_SQL,
    "normalize_url": f"SELECT page_id, {norm_url_sql('url')} AS nurl, CASE WHEN {norm_url_sql('url')} = '' THEN '' ELSE md5({norm_url_sql('url')}) END AS url_hash FROM pages",
    "safe_filter": f"WITH {ARTICLES} SELECT news_id FROM articles WHERE source_site IN ('src1', 'src2') AND author = 'en' AND contains(title, 'th') UNION ALL SELECT news_id FROM articles WHERE publish_date IS NULL AND crawl_version = 3",
    "dedup_batch": f"WITH {ARTICLES}, {INCOMING}, {STATUS} SELECT seq, md5(nurl) AS url_hash, is_duplicate FROM ranked",
    "simhash": SIMHASH_SQL,
    "hamming": "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS bits FROM events",
    "classify_incoming": f"WITH {ARTICLES}, {INCOMING}, {STATUS} SELECT seq, news_id, kind AS status FROM checked",
    "upsert": UPSERT_SQL.replace("%d", "6").replace("%s FROM u %s", " + 1 FROM u"),
    "upsert_update_only": UPSERT_SQL.replace("%d", "8").replace("%s FROM u %s", " FROM u WHERE news_id IN (SELECT news_id FROM articles)"),
    "partial_update": f"WITH {ARTICLES} SELECT news_id, title, CASE WHEN doc_id % 3 = 0 THEN 'new ' || author ELSE author END AS author FROM articles",
    "delete_ids": f"WITH {ARTICLES} SELECT news_id FROM articles WHERE doc_id % 4 <> 1",
    "existing_urls": f"WITH {ARTICLES}, {INCOMING} SELECT seq, news_id FROM incoming WHERE {norm_url_sql('url')} IN (SELECT {norm_url_sql('url')} FROM articles)",
    "fetch_by_ids": f"WITH {ARTICLES} SELECT l.doc_id AS position, a.news_id, a.title FROM labels l JOIN articles a ON a.doc_id = l.doc_id * 2",
    "ingest_statuses": f"{INGEST} SELECT seq, news_id, status FROM final",
    "ingest_summary": f"{INGEST} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'upsert') AS upsert, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'error') AS error FROM final",
    "ingest_table": f"{INGEST}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY seq DESC) AS n FROM final WHERE status IN ('success', 'upsert')) WHERE n = 1) SELECT news_id, url, strftime(publish_date, '%Y-%m-%d') AS day FROM articles WHERE news_id NOT IN (SELECT news_id FROM w) UNION ALL SELECT news_id, url, strftime(publish_date, '%Y-%m-%d') FROM w",
}
