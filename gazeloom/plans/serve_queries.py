"""Queries of discovery, vectors, retrieval, lists, reviews, activity, conversations and streams."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.functions import html as H
from gazeloom.functions import text as X
from gazeloom.operators import activity as A
from gazeloom.operators import ann as N
from gazeloom.operators import conversations as C
from gazeloom.operators import discover as D
from gazeloom.operators import listing as L
from gazeloom.operators import pages as G
from gazeloom.operators import postings as P
from gazeloom.operators import retrieval as R
from gazeloom.operators import reviews as W
from gazeloom.operators import vectors as V
from gazeloom.operators.adapt import adapt_submission
from gazeloom.plans.ingest_queries import INGEST, submissions
from gazeloom.plans.views import ARTICLES, LIST_PAGES, REQUESTS, api_keys, articles, list_pages, requests, strip_sql, table, vector_sql, words_sql
from gazeloom.sources.crawl import read_app_logs
from gazeloom.staging import delete, new_path, stage
from gazeloom.streaming import seen as E
from gazeloom.streaming import streams as S
from gazeloom.streaming.buckets import found_paths

# --- discovery


def page_urls(spark, sf):
    seeds = table(spark, sf, "nation").select(F.concat(F.lit("http://h"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 3 == 0, "/list.htm").when(F.col("n_nationkey") % 3 == 1, "/list7.htm").otherwise("/index")).alias("list_url"))
    return D.list_page_urls(seeds, 5)


def links(spark, sf):
    return D.extract_links(list_pages(spark, sf).drop("url")).select("list_url", "page", "url")


def odd_links(spark, sf):
    """Links of the list pages, behind one in single quotes and one with entities."""
    more = F.concat(F.lit("<a href='/q"), "page", F.lit("'>q</a><a href=\"/a?x=1&amp;y=&quot;"), "page", F.lit('&quot;">a</a>'))
    return D.extract_links(list_pages(spark, sf).drop("url").withColumn("html", F.concat(more, "html"))).select("list_url", "page", "url")


def kept_links(spark, sf):
    return D.filter_links(links(spark, sf), ["/[A-M]", "/th"], ["ing"])


def cut(spark, sf):
    return D.pagination_cut(list_pages(spark, sf), links(spark, sf)).select("list_url", "url")


def new_urls(spark, sf):
    found = links(spark, sf)
    fresh, seen = D.incremental_urls(found, found.where("page = 1"))
    return fresh.groupBy("list_url").agg(F.count(F.lit(1)).alias("n")).join(seen.groupBy("list_url").agg(F.count(F.lit(1)).alias("seen")), "list_url", "full").select("list_url", F.coalesce("n", F.lit(0)).alias("n"), "seen")


def metadata(spark, sf):
    return D.page_metadata(table(spark, sf, "pages")).select("page_id", "title", "date", "author")


def stripped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(H.strip_html("html")).alias("text_md5"), F.length(H.strip_html("html")).alias("n"))


def cleaned(spark, sf):
    a = articles(spark, sf)
    md = F.concat(F.lit("|--|\n"), "title", F.lit("\n\n2024-01-02\n"), "content_text", F.lit("\n|  | a\n| b\n| c\n| d\n| e\nend"))
    return a.select("news_id", H.clean_article_markdown(md, F.col("title"), F.lit("2024-01-02")).alias("markdown"))


def tables_(spark, sf):
    t = F.concat(F.lit('<table class="x" align="left"><tr><td colspan="2" style="s">'), F.regexp_extract("html", "<title>([^<]*)", 1), F.lit('</td><td><img src="/icon_pdf.gif"/></td></tr></table><table><tr><td>plain</td></tr></table>'))
    return table(spark, sf, "pages").select("page_id", F.explode(H.complex_tables(F.concat("html", t))).alias("table"))


def images(spark, sf):
    md = F.concat(F.lit("![a$1](/_upload/"), F.col("page_id").cast("string"), F.lit(".png) ![b](/other/x.png) ![c](http://z/y.png)"))
    return table(spark, sf, "pages").select("page_id", X.absolutize_images(md, F.col("url")).alias("md"))


def pdfs(spark, sf):
    frame = F.concat(F.lit('<iframe class="wp_pdf_player" src="/_js/viewer.html?file=/_upload/f%20'), F.col("page_id").cast("string"), F.lit('.pdf&amp;x=1"></iframe>'))
    return table(spark, sf, "pages").select("page_id", F.explode(H.pdf_links(F.concat("html", frame), F.col("url"))).alias("p")).select("page_id", "p.url", "p.label")


def report(spark, sf):
    return D.crawl_report(list_pages(spark, sf).withColumn("source", F.lit("")))


#: Entities that the pages hold.
PAGE_ENTITIES = (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def entities_sql(c: str, entities=PAGE_ENTITIES) -> str:
    """Entities decoded, the ampersand last; as in HTML, one that a title cuts off before its semicolon counts too."""
    for entity, text in entities:
        c = f"regexp_replace({c}, '{entity}?', '{text}', 'g')"
    return c


def page_text_sql(c: str) -> str:
    """Text of HTML: scripts, styles, comments and tags give way to a space, entities are decoded, white space is single spaces."""
    c = entities_sql(f"regexp_replace({c}, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({c}, '[\\s\u00a0]+', ' ', 'g'))"


STRIPPED_SQL = f"SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n FROM (SELECT page_id, {page_text_sql('html')} AS t FROM pages)"
METADATA_SQL = f"""WITH p AS (SELECT page_id, {page_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h, {page_text_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t FROM pages)
SELECT page_id, CASE WHEN h <> '' THEN h ELSE t END AS title, '' AS date, '' AS author FROM p"""
#: The cell's text is decoded, and written with its ampersands and angle brackets escaped.
TABLES_SQL = f"""SELECT page_id, '<table align="left"><tr><td colspan="2">' || replace(replace(replace({entities_sql("regexp_extract(html, '<title>([^<]*)', 1)")}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td></td></tr></table>' AS table FROM pages"""
CLEANED_SQL = f"""WITH {ARTICLES}, t AS (SELECT news_id, title, string_split('|--|' || chr(10) || title || chr(10) || chr(10) || '2024-01-02' || chr(10) || content_text, chr(10)) AS ls FROM articles),
l AS (SELECT *, list_transform(ls, lambda x: {strip_sql("x")}) AS s FROM t),
h AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: NOT (s[i] = '' OR regexp_full_match(s[i], '[|-]+') OR (title <> '' AND contains(s[i], title)) OR (i <= 5 AND contains(s[i], '2024-01-02'))))[1] AS begin FROM l)
SELECT news_id, {strip_sql("array_to_string(list_append(CASE WHEN begin IS NULL THEN [] ELSE list_transform(list_filter(range(begin, len(s) + 1), lambda i: s[i] <> '2024-01-02'), lambda i: ls[i]) END, 'end'), chr(10))")} AS markdown FROM h"""

HOST = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"

# --- vectors


def queries_(spark, sf):
    """A share of the vectors that grows with the table."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("news_id"), F.col("embedding").alias("content_embedding"), "label")


def text_queries(spark, sf):
    """Every benchmark text, whole, as a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_ops(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    j = e.crossJoin(F.broadcast(first))  # one row
    a, b = F.col("embedding"), F.col("q")
    return j.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("cosine", V.cosine(a, b)), ("distance", V.euclidean(a, b)), ("similarity", V.euclidean_similarity(a, b)), ("length", V.norm(V.l2_normalize(a))), ("mixed", V.dot(V.weighted_sum(a, b, 0.3, 0.7), b)))])


def embedded(spark, sf):
    out = V.embed_columns(articles(spark, sf).select("news_id", "title", "content_text"), {"title_embedding": ("title", 384), "content_embedding": ("content_text", 1024)})
    return out.select("news_id", *[c for name, short in (("title_embedding", "title"), ("content_embedding", "content")) for c in (F.size(name).alias(f"{short}_width"), *value_sums(name, short))])


def value_sums(vector, name):
    """Sums over a vector in which each place has another weight, so that two vectors with the same sums are the same."""
    places = lambda f: F.aggregate(F.transform(vector, f), F.lit(0.0), lambda s, x: s + x)
    return F.round(places(lambda x, i: x * (i % 97 + 1)), 2).alias(f"{name}_a"), F.round(places(lambda x, i: x * ((i * 31) % 89 - 44)), 2).alias(f"{name}_b")


def value_sums_sql(vectors, name):
    """The same sums from rows of (id, i, x)."""
    return f"SELECT id, round(sum(x * (i % 97 + 1)) / sqrt(sum(x * x)), 2) AS {name}_a, round(sum(x * ((i * 31) % 89 - 44)) / sqrt(sum(x * x)), 2) AS {name}_b FROM ({vectors}) GROUP BY id"


EMBED_SQL = f"""WITH {ARTICLES}, tw AS (SELECT news_id AS id, {words_sql("title")} AS w FROM articles), cw AS (SELECT news_id AS id, {words_sql("content_text")} AS w FROM articles),
t AS ({value_sums_sql(vector_sql("tw", 384), "title")}), c AS ({value_sums_sql(vector_sql("cw", 1024), "content")})
SELECT news_id, 384 AS title_width, coalesce(title_a, 0.0) AS title_a, coalesce(title_b, 0.0) AS title_b, 1024 AS content_width, coalesce(content_a, 0.0) AS content_a, coalesce(content_b, 0.0) AS content_b
FROM articles a LEFT JOIN t ON t.id = a.news_id LEFT JOIN c ON c.id = a.news_id"""


#: The rows that tags come from, a share of the vectors that grows with the table.
SHARED_TAGS = "vec_id % 50 = 0"


def tags_(spark, sf, which=SHARED_TAGS):
    return table(spark, sf, "embeddings").where(which).select(F.concat(F.lit("tag_"), F.col("vec_id").cast("string")).alias("tag_id"), F.concat(F.lit("name"), F.col("vec_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("category"), "embedding")


def tag_embeddings(spark, sf):
    t = tags_(spark, sf).drop("embedding").withColumn("description", F.when(F.col("tag_id") < "tag_3", F.concat(F.lit("about "), "category")))
    out = V.embed_tags(t.where("tag_id < 'tag_2'"), t.where("tag_id >= 'tag_2'").withColumn("category", F.lit(None).cast("string")), width=64)
    return out.select("tag_id", "category", F.size("embedding").alias("width"), *value_sums("embedding", "sum"))


EMBED_TAGS_SQL = f"""WITH t AS (SELECT 'tag_' || vec_id AS tag_id, 'c' || (label % 3) AS category, 'name' || vec_id || ': ' || CASE WHEN 'tag_' || vec_id < 'tag_3' THEN 'about c' || (label % 3) ELSE '' END AS text FROM embeddings WHERE {SHARED_TAGS}),
w AS (SELECT tag_id AS id, {words_sql("text")} AS w FROM t), v AS ({value_sums_sql(vector_sql("w", 64), "sum")})
SELECT tag_id, CASE WHEN tag_id < 'tag_2' THEN category ELSE 'general' END AS category, 64 AS width, sum_a, sum_b FROM t JOIN v ON v.id = t.tag_id"""


#: Least similarity of a tag; the vectors here are seldom nearer.
TAGGED_FROM = 0.3


def matched(spark, sf):
    return V.match_tags(corpus(spark, sf), tags_(spark, sf), TAGGED_FROM).select("news_id", "tag_id", F.round("score", 6).alias("score"), "rank")


def merged_tags(spark, sf):
    a = articles(spark, sf, vectors=True)
    return V.merge_tags(a, V.match_tags(a, tags_(spark, sf), TAGGED_FROM)).select("news_id", F.array_join("tags", ",").alias("tags"))


def like_tags(spark, sf):
    return V.similar_tags(corpus(spark, sf), tags_(spark, sf), 3, 0.2).select("news_id", "tag_id", F.round("score", 6).alias("score"), "rank")


def named_tags(spark, sf):
    """Tags of the sources, by the words of their names."""
    names = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws("_", "source", "lang").alias("tag_id"), F.concat_ws(" ", "source", "lang", "source").alias("name"))
    return V.find_tags(names, "src3 FR nothing", 10).select("tag_id", F.round("score", 6).alias("score"), "rank")


NAMED_SQL = """WITH t AS (SELECT DISTINCT source || '_' || lang AS tag_id, source, lang FROM documents), n AS (SELECT count(*) AS n FROM t),
w AS (SELECT tag_id, 'src3' AS term, 2 AS tf FROM t WHERE source = 'src3' UNION ALL SELECT tag_id, 'fr', 1 FROM t WHERE lang = 'fr'), d AS (SELECT term, count(*) AS df FROM w GROUP BY term),
s AS (SELECT tag_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 9) AS s FROM w JOIN d USING (term), n GROUP BY tag_id)
SELECT tag_id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, tag_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""


def nearest(spark, sf, queries=queries_):
    return V.vector_search(queries(spark, sf), corpus(spark, sf), 10).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


def approximate(spark, sf, queries=queries_):
    return N.ann_search(queries(spark, sf), corpus(spark, sf), 10).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


def semantic(spark, sf, queries=queries_):
    return R.semantic_search(queries(spark, sf), corpus(spark, sf), 0.3, 10).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


def alike(spark, sf):
    ids = corpus(spark, sf).where("news_id % 25 = 0").select("news_id")
    return R.similar_documents(ids, corpus(spark, sf), 5).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


def all_alike(spark, sf):
    """The nearest rows of every row."""
    return R.similar_documents(None, corpus(spark, sf), 5).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


def embedded_queries(spark, sf):
    """Benchmark texts as queries, with the prefix that articles don't have."""
    out = V.embed_queries(text_queries(spark, sf), 256, prefix=V.QUERY_PREFIX)
    return out.select("query_id", F.size("vector").alias("width"), *value_sums("vector", "sum"))


def matches_sql(threshold: float, k: int, articles: str) -> str:
    return f"""WITH t AS (SELECT 'tag_' || vec_id AS tag_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {SHARED_TAGS}),
s AS (SELECT a.vec_id AS news_id, tag_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), t.e) AS s FROM embeddings a, t WHERE {articles}),
m AS (SELECT news_id, tag_id, s, CAST(row_number() OVER (PARTITION BY news_id ORDER BY s DESC, tag_id) AS INTEGER) AS rank FROM s WHERE s >= {threshold})
SELECT news_id, tag_id, round(s, 6) AS score, rank FROM m WHERE rank <= {k}"""


def nearest_sql(where: str, k: int, also: str = "true", threshold: float = -2) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS news_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings c WHERE {where} AND {also}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, news_id) AS INTEGER) AS rank FROM s)
SELECT query_id, news_id, round(s, 6) AS score, rank FROM r WHERE rank <= {k} AND s >= {threshold}"""


# --- retrieval by words


def filtered(spark, sf):
    return R.article_filter(articles(spark, sf), "src3", None, ["en", "fr"], "2024-02-01", "2024-11-30", 2).select("news_id")


def fulltext(spark, sf):
    return R.fulltext_search(text_queries(spark, sf), articles(spark, sf), 10).select("query_id", "news_id", F.round("score", 5).alias("score"))


BM25 = f"""{ARTICLES}, qt AS (
  SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')) AS term FROM benchmark
), w AS (
  SELECT news_id, unnest(list_filter(string_split_regex(lower(title || ' ' || content_text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')) AS term FROM articles
), len AS (SELECT a.news_id, coalesce(n, 0) AS n FROM articles a LEFT JOIN (SELECT news_id, count(*) AS n FROM w GROUP BY 1) USING (news_id)),
mean AS (SELECT avg(n) AS mean, count(*) AS docs FROM len),
tf AS (SELECT news_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
hits AS (SELECT query_id, news_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS s FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (news_id), mean GROUP BY ALL),
text_hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, news_id) AS INTEGER) AS rank FROM hits)"""


def is_word_sql(c: str) -> str:
    return f"regexp_matches({c}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')"


# A word's edge lies where of two characters side by side one belongs to a word and one doesn't; where nothing stands between two occurrences of a term, they are each other's neighbours.
BEFORE = f"{is_word_sql("right(CASE WHEN ps[i] = '' THEN t ELSE ps[i] END, 1)")} <> {is_word_sql('left(t, 1)')}"
AFTER = f"{is_word_sql("left(CASE WHEN ps[i + 1] = '' THEN t ELSE ps[i + 1] END, 1)")} <> {is_word_sql('right(t, 1)')}"
SIMPLE_SQL = f"""WITH {ARTICLES}, q AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower({strip_sql("text")}), '\\s+'), lambda t: t <> '')) AS t FROM benchmark),
fields AS (SELECT news_id, unnest([lower(title), lower(content_text), lower(source_site), lower(author)]) AS f FROM articles), d AS (SELECT DISTINCT t FROM q),
p AS (SELECT news_id, t, f, string_split(' ' || f || ' ', t) AS ps FROM fields, d WHERE contains(f, t)),
w AS (SELECT news_id, t, sum(CASE WHEN f = t THEN 2 WHEN len(list_filter(range(1, len(ps)), lambda i: {BEFORE} AND {AFTER})) > 0 THEN 1.5 ELSE 1 END) AS w FROM p GROUP BY ALL),
s AS (SELECT query_id, news_id, CAST(sum(w) AS DOUBLE) AS score FROM q JOIN w USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, news_id) AS rank FROM s WHERE score > 0)
SELECT query_id, news_id, score FROM r WHERE rank <= 5"""


def fulltext_indexed(spark, sf):
    """fulltext_search over stored postings, of two batches of articles one after the other."""
    a, path = articles(spark, sf), new_path(spark, "postings")
    P.add_postings(a.where("doc_id % 3 <> 0"), path, 0, buckets=8)
    P.add_postings(a.where("doc_id % 3 = 0"), path, 1, buckets=8)
    return P.search_postings(text_queries(spark, sf), path, 10, buckets=8).select("query_id", "news_id", F.round("score", 5).alias("score"))


def simple_plain(spark, sf):
    """simple_text_search for every benchmark item, marks and all."""
    return R.simple_text_search(text_queries(spark, sf), articles(spark, sf), 5).select("query_id", "news_id", "score")


def hits_(spark, sf, k=20, queries=queries_):
    a = articles(spark, sf)
    vector = V.vector_search(queries(spark, sf), articles(spark, sf, vectors=True), k)
    return vector, R.fulltext_search(text_queries(spark, sf), a, k)


def merged_fields(spark, sf, queries=queries_):
    vector, text = hits_(spark, sf, queries=queries)
    return R.merge_field_ranks(text, vector).select("query_id", "news_id", F.round("score", 6).alias("score"), F.round("title_score", 6).alias("title_score"))


def fused(spark, sf, queries=queries_):
    vector, text = hits_(spark, sf, queries=queries)
    return R.fuse_ranks(vector, text).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


VECTOR_HITS = """vector_hits AS (SELECT * FROM (SELECT query_id, news_id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, news_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, 'doc_' || c.vec_id AS news_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 20)"""
TWENTY = "th AS (SELECT * FROM text_hits WHERE rank <= 20)"
FUSE = """parts AS (SELECT query_id, news_id, 0.7 / rank * greatest(0.5, 1 - (rank - 1) / 20) AS p FROM {v} UNION ALL SELECT query_id, news_id, 0.3 / rank * greatest(0.3, 1 - (rank - 1) / 15) FROM th),
fused AS (SELECT query_id, news_id, sum(p) AS s FROM parts GROUP BY ALL), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, news_id) AS INTEGER) AS rank FROM fused)"""


def all_queries(spark, sf):
    """Every benchmark item, with the vector of the same number if there is one."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return text_queries(spark, sf).join(e, "query_id", "left")


def two_vectors(spark, sf):
    """Articles whose title has a vector of its own: that of the content from its end."""
    return articles(spark, sf, vectors=True).withColumn("title_embedding", F.reverse("content_embedding"))


def hybrid(spark, sf):
    return R.hybrid_search(all_queries(spark, sf), two_vectors(spark, sf), 10).select("query_id", "news_id", F.round("score", 6).alias("score"), "rank")


def hits_sql(name: str, vector: str) -> str:
    """The 20 nearest articles of each query that has a vector."""
    return f"""{name} AS (SELECT * FROM (SELECT query_id, news_id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, news_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, 'doc_' || c.vec_id AS news_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST({vector} AS DOUBLE[])) AS s FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 20)"""


HYBRID = f"""WITH {BM25}, {TWENTY}, {hits_sql("content_hits", "c.embedding")}, {hits_sql("title_hits", "list_reverse(c.embedding)")},
both_hits AS (SELECT query_id, news_id, sum(p) AS p FROM (SELECT query_id, news_id, 0.7 / rank AS p FROM content_hits UNION ALL SELECT query_id, news_id, 0.3 / rank FROM title_hits) GROUP BY ALL),
merged AS (SELECT query_id, news_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p DESC, news_id) AS INTEGER) AS rank FROM both_hits), {FUSE.format(v="merged")},
hybrid AS (SELECT * FROM ranked WHERE rank <= 10)"""


def advanced(spark, sf):
    a, q = two_vectors(spark, sf), all_queries(spark, sf)
    return R.advanced_search(q, a, R.hybrid_search(q, a, 10)).select("query_id", "news_id", F.round("score", 5).alias("score"))


def keyword(match):
    def run(spark, sf):
        q = text_queries(spark, sf)
        return R.keyword_search(q, articles(spark, sf), 5, match).select("query_id", "news_id", F.round("score", 5).alias("score"))

    return run


def keyword_sql(match: str, most: int | None = 15) -> str:
    """The best 5 hits that match, of all hits, or of the best `most`."""
    q = f"lower({strip_sql("b.text")})"
    text = "lower(a.title || ' ' || a.content_text)"
    fits = {"any": "true", "all": f"len(list_filter(list_filter(string_split_regex({q}, '\\s+'), lambda t: t <> ''), lambda t: NOT contains({text}, t))) = 0", "phrase": f"contains({text}, {q})"}[match]
    return f"""WITH {BM25}, f AS (SELECT h.query_id, h.news_id, h.s FROM text_hits h JOIN benchmark b ON b.item_id = h.query_id JOIN articles a ON a.news_id = h.news_id WHERE {f"h.rank <= {most} AND " if most else ""}{fits}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, news_id) AS rank FROM f) SELECT query_id, news_id, round(s, 5) AS score FROM r WHERE rank <= 5"""


def results(spark, sf, queries=queries_):
    a = articles(spark, sf, vectors=True)
    h = V.vector_search(queries(spark, sf), a, 10)
    return R.search_results(h, a).select("query_id", "rank", "news_id", "label", "detail_url", "is_page", F.round("similarity_score", 6).alias("similarity_score"), F.round("distance", 6).alias("distance"))


def snippets(spark, sf):
    return R.search_snippets(articles(spark, sf), content=1000).select("news_id", "summary", F.md5("content").alias("content_md5"), "content_truncated", "published_date")


STRIPPED = strip_sql("content_text")


def snip_sql(n: int) -> str:
    return f"CASE WHEN length({STRIPPED}) > {n} THEN regexp_replace(left({STRIPPED}, {n}), '\\s+$', '') || '…' ELSE {STRIPPED} END"

# --- lists and statistics


def paged(spark, sf):
    n = L.project_notices(articles(spark, sf))
    page, total = L.notice_page(n, 2, 20)
    return page.select("id", "label", "date").crossJoin(F.broadcast(total))


def found(spark, sf):
    return L.find_articles(articles(spark, sf), 15, author="en", any_tag=["src1", "src2", "src5"]).select("news_id")


def notices(spark, sf):
    n = F.col("doc_id")
    a = articles(spark, sf).withColumn("source_site", F.when(n % 14 == 0, " \t").when(n % 14 == 2, F.concat(F.lit(" "), "source_site", F.lit("\t"))).otherwise(F.col("source_site")))
    a = a.withColumn("metadata", F.when(n % 35 == 10, '{"is_page":null,"label":" m9 "}').otherwise(F.col("metadata")))
    return L.project_notices(a.withColumn("tags", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" "))).otherwise(F.col("tags"))).withColumn("news_id", F.when(F.col("doc_id") % 31 == 0, "None").otherwise(F.col("news_id")))).select("id", "label", "date", "detail_url", "is_page", "attachments")


def keys_(spark, sf):
    return api_keys(spark, sf).join(A.usage_totals(A.admission_replay(requests(spark, sf), api_keys(spark, sf))).select("key", F.col("requests").alias("total_requests")), "key", "left")


def deep_page(spark, sf):
    """The last full page of all notices, by a range index."""
    index = G.index_pages(L.project_notices(articles(spark, sf)), "notices", new_path(spark, "notice-pages"), 500)
    total = index.page(spark, 1, 1)[1].first()["total"]
    page, total = index.page(spark, total // 20, 20)
    return page.select("id", "label", "date").crossJoin(F.broadcast(total))  # one row


def listed(spark, sf, kind):
    """The rows of a list, in which several share their date or moment and some have none."""
    if kind == "submissions":
        n = F.col("seq")
        rows = submissions(spark, sf).withColumn("date", F.when(n % 11 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 40).cast("int")), "yyyy-MM-dd")))
        return rows.select(F.concat(F.lit("s"), n.cast("string")).alias("id"), "title", "date", F.when(n % 3 == 0, "approved").otherwise("pending").alias("status"))
    if kind == "keys":
        n = F.col("key").cast("int")
        return api_keys(spark, sf).select("key", F.concat(F.lit("o"), (n % 10).cast("string")).alias("owner"), F.date_add(F.lit("2024-01-01").cast("date"), n % 7).alias("created_at"))
    n = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(n.alias("id"), F.col("c_name").alias("username"), F.when(n % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int"))).alias("created_at"), F.when(n % 5 == 0, "rejected").otherwise("pending").alias("status"), (n % 4 != 0).alias("is_active"))
    return rows.drop("is_active") if kind == "registrations" else rows.drop("status")


def listed_page(kind, page, size, value):
    return lambda spark, sf: (lambda rows, total: rows.crossJoin(F.broadcast(total)))(*G.index_pages(listed(spark, sf, kind), kind, new_path(spark, f"{kind}-pages"), 200).page(spark, page, size, value))  # total: one row


# --- reviews


def ids(spark, sf):
    return W.submission_ids(submissions(spark, sf)).select("submission_id", "seq", "size")


def decisions_(spark, sf, subs):
    return table(spark, sf, "labels").join(subs.select("submission_id", F.col("seq").alias("doc_id")), "doc_id").select("submission_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending").alias("action"), F.lit("ok").alias("review"), F.col("doc_id").alias("seq"))


def reviewed(spark, sf):
    """All that the default limit lets through, against the articles and a part of the submissions that are stored already: as they are (seq % 10 = 0), or with a
    later date (seq % 10 = 5, of those with a URL of their own), which makes them updates, and an approval of these isn't accepted."""
    subs = W.submission_ids(submissions(spark, sf))
    earlier = subs.where("seq % 10 = 0 OR (seq % 10 = 5 AND seq % 3 <> 0)")
    late = adapt_submission(earlier.withColumn("date", F.when(F.col("seq") % 10 == 5, "2024-04-06").otherwise(F.col("date"))))
    stored = articles(spark, sf).drop("doc_id").unionByName(late)
    return W.apply_reviews(subs, decisions_(spark, sf, subs), stored)["submissions"].select("submission_id", "status", "review")


REVIEWS_SQL = f"""WITH d AS (SELECT doc_id, sha256(left(text, 25) || '2024-04-05' || CASE WHEN doc_id % 3 = 0 THEN 'http://s/' || (doc_id % 50) ELSE '' END) AS submission_id, text, left(text, 25) AS title FROM documents WHERE length(text) <= 10000),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY doc_id) AS n FROM d) WHERE n = 1),
j AS (SELECT s.*, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN l.doc_id IS NOT NULL THEN 'pending' END AS action, {strip_sql('title')} <> '' AND {strip_sql('text')} <> '' AND length(text) >= 10 AND NOT (doc_id % 10 = 5 AND doc_id % 3 <> 0) AS good FROM s LEFT JOIN labels l USING (doc_id))
SELECT submission_id, CASE WHEN action = 'rejected' THEN 'rejected' WHEN action = 'approved' AND good THEN 'approved' ELSE 'pending' END AS status, CASE WHEN action IS NULL OR (action = 'approved' AND NOT good) THEN '' ELSE 'ok' END AS review FROM j"""


def mine(spark, sf):
    return W.my_submissions(submissions(spark, sf), "u7").select("seq", "title")


def registrations(spark, sf):
    c = table(spark, sf, "customer")
    n = F.col("c_custkey")
    r = c.where("c_custkey % 2 = 1").select(n.alias("registration_id"), F.when(n % 50 == 1, "twin").otherwise(F.col("c_name")).alias("username"), F.concat("c_name", F.lit("@x")).alias("email"), F.lit("h").alias("password_hash"), F.lit("pending").alias("status"), F.lit("").alias("review"))
    u = c.where("c_custkey % 2 = 0").select(F.when(n % 50 == 2, F.regexp_replace("c_name", ".$", "1")).otherwise(F.col("c_name")).alias("username"), F.concat("c_name", F.lit("@y")).alias("email"), F.lit("h").alias("password_hash"))
    d = r.select("registration_id", F.when(F.col("registration_id") % 5 == 0, "rejected").otherwise("approved").alias("action"), F.lit("seen").alias("review"), F.col("registration_id").alias("seq")).where("registration_id % 7 <> 0")
    done = W.apply_registrations(r, d, u)
    return done["added"].select("registration_id", F.lit("added").alias("state")).union(done["registrations"].select("registration_id", "status"))


REGISTRATIONS_SQL = """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 1 THEN 'twin' ELSE c_name END AS username FROM customer WHERE c_custkey % 2 = 1),
u AS (SELECT CASE WHEN c_custkey % 50 = 2 THEN regexp_replace(c_name, '.$', '1') ELSE c_name END AS username FROM customer WHERE c_custkey % 2 = 0),
ok AS (SELECT id, row_number() OVER (PARTITION BY username ORDER BY id) AS n FROM r WHERE id % 7 <> 0 AND id % 5 <> 0 AND username NOT IN (SELECT username FROM u)),
added AS (SELECT id FROM ok WHERE n = 1)
SELECT id AS registration_id, CASE WHEN id IN (SELECT id FROM added) THEN 'added' WHEN id % 7 <> 0 AND id % 5 = 0 THEN 'rejected' ELSE 'pending' END AS state FROM r"""

# --- activity


def replay(spark, sf):
    return A.admission_replay(requests(spark, sf), api_keys(spark, sf)).select("event_id", "outcome")


def usage(spark, sf):
    return A.usage_totals(A.admission_replay(requests(spark, sf), api_keys(spark, sf))).select("key", "requests", F.array_join("devices", ",").alias("devices"))


def devices(spark, sf):
    return A.latest_devices(requests(spark, sf).where("event_type = 'signup'").withColumn("user_id", F.col("key"))).select("user_id", "device", "event_id", "logins")


def logs(spark, sf):
    e = table(spark, sf, "events")
    level = F.rpad(F.when(F.col("event_id") % 7 == 0, "ERROR").otherwise("INFO"), 8, " ")  # as log files have it
    head = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] [m"), (F.col("user_id") % 5).cast("string"), F.lit("] [f.py:1] - event "), F.col("event_id").cast("string"))
    more = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("\nTraceback\n  of "), "event_type")).otherwise("")
    path = new_path(spark, "logs")
    e.select(F.concat(head, more).alias("value")).write.text(path)
    return A.parse_logs(read_app_logs(spark, path))


def error_logs(spark, sf):
    return A.filter_logs(logs(spark, sf), "error", None, "SIGNUP").select("module", "message")


LOGS = """logs AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 7 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, 'm' || (user_id % 5) AS module,
  'event ' || event_id || CASE WHEN event_id % 7 = 0 THEN chr(10) || 'Traceback' || chr(10) || '  of ' || event_type ELSE '' END AS message FROM events)"""

# --- conversations


def recent(spark, sf):
    return C.recent_turns(table(spark, sf, "conversations"), 3).select("conv_id", "turn")


def trimmed(spark, sf):
    return C.trim_by_budget(table(spark, sf, "conversations"), 500).select("conv_id", "turn")


def observed(spark, sf):
    """Turns as observations, whose cost is their length as JSON."""
    return C.trim_by_budget(table(spark, sf, "conversations"), 700, C.observation_cost("turn", "role", "text")).select("conv_id", "turn")


def asked_texts(spark, sf):
    """All texts of documents, benchmark and conversations, as they are."""
    rows = [
        table(spark, sf, name).select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("id"), turn.cast("long").alias("turn"), F.col("text").alias("query"))
        for name, key, turn in (("documents", "doc_id", F.lit(None)), ("benchmark", "item_id", F.lit(None)), ("conversations", "conv_id", F.col("turn")))
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def intents(spark, sf):
    return C.classify_queries(asked_texts(spark, sf)).drop("query")


def time_windows(spark, sf):
    return C.infer_time_windows(asked_texts(spark, sf), F.lit("2024-02-01").cast("date")).drop("query")


ASKED_SQL = f"""asked AS (SELECT *, {strip_sql("query")} AS q, lower({strip_sql("query")}) AS low FROM (
  SELECT 'documents' AS kind, doc_id AS id, CAST(NULL AS BIGINT) AS turn, text AS query FROM documents UNION ALL SELECT 'benchmark', item_id, NULL, text FROM benchmark UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations))"""


def any_sql(words) -> str:
    return f"regexp_matches(low, '{'|'.join(words)}')"


INTENT_SQL = f"""WITH {ASKED_SQL} SELECT kind, id, turn, CASE WHEN regexp_matches(q, 'https?://\\S+') OR ({any_sql(X.LINK_WORDS)} AND {any_sql(X.VERIFY_WORDS)}) THEN 'link_verification' WHEN {any_sql(X.COUNT_WORDS)} THEN 'statistics'
  WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])[0-9]{{6,8}}[_-][A-Za-z0-9_-]*[A-Za-z0-9_]($|[^\\p{{L}}\\p{{N}}_])') OR {any_sql(X.DETAIL_WORDS)} THEN 'detail' ELSE 'fuzzy_qa' END AS intent FROM asked"""
WINDOW_SQL = f"""WITH {ASKED_SQL}, n AS (SELECT *, regexp_extract(low, '近\\s*([0-9]{{1,3}})\\s*(天|日|周|星期|个月|月)', 2) AS unit, greatest(1, coalesce(TRY_CAST(regexp_extract(low, '近\\s*([0-9]{{1,3}})\\s*(天|日|周|星期|个月|月)', 1) AS INTEGER), 1)) AS n FROM asked),
w AS (SELECT kind, id, turn, CASE WHEN unit IN ('天', '日') THEN ['近' || n || '天', CAST(DATE '2024-02-01' - (n - 1) AS VARCHAR)] WHEN unit IN ('周', '星期') THEN ['近' || n || '周', CAST(DATE '2024-02-01' - (7 * n - 1) AS VARCHAR)] WHEN unit <> '' THEN ['近' || n || '月', CAST(DATE '2024-02-01' - (30 * n - 1) AS VARCHAR)]
  WHEN contains(query, '本周') THEN ['本周', '2024-01-29'] WHEN contains(query, '本月') THEN ['本月', '2024-02-01'] WHEN {any_sql(X.RECENT_WORDS)} THEN ['近期(近30天)', '2024-01-03'] END AS w FROM n)
SELECT kind, id, turn, w[1] AS label, w[2] || 'T00:00:00' AS start_date, CASE WHEN w IS NOT NULL THEN '2024-02-01T23:59:59' END AS end_date FROM w"""


def rag(spark, sf):
    """Every second query has a chosen article; queries of negative id have no hits."""
    a = articles(spark, sf, vectors=True)
    q = queries_(spark, sf)
    h = V.vector_search(q, a, 10)
    chosen = q.where("query_id % 100 = 0").select("query_id", F.concat(F.lit("doc_"), (F.col("query_id") + 3).cast("string")).alias("news_id"), F.lit(1).alias("position"))
    missed = q.where("query_id % 150 = 0").select((-1 - F.col("query_id")).alias("query_id"))
    return C.rag_context(q.select("query_id").unionByName(missed), h, a, chosen).select("query_id", F.md5("context").alias("context_md5"))


def cited(spark, sf):
    o = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.concat(F.lit("http://"), "event_type", F.lit("/"), (F.col("event_id") % 5).cast("string")).alias("url"))
    return C.cited_sources(o).select("session", F.array_join("urls", " ").alias("urls"))


# --- streams, run to their end


def drain(frame, name, mode="append"):
    """Run a stream to its end; in update mode the rows of all batches, with their number in column batch."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    if mode == "append":
        frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(frame.schema).parquet(path)
    frame.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*frame.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)


#: Rows of a file that a stream reads.
FILE_ROWS = 20_000


def streamed(spark, sf, frame, name, parts=None):
    """A frame written as files and read as a stream of them. Conditions in parts cut it into batches, written one after the other and read so: state goes from each to the next.

    A batch is as many files as the largest part has FILE_ROWS rows; a part that comes to fewer is filled up with files without rows. Files are deleted once their batch is done.
    """
    path = new_path(spark, name)
    if parts is None:
        frame.write.parquet(path)
        return spark.readStream.schema(frame.schema).parquet(path)
    most = frame.agg(*[F.count_if(p if isinstance(p, Column) else F.expr(p)) for p in parts]).first()  # one row
    files = max(1, math.ceil(max(most) / FILE_ROWS))
    spark.createDataFrame([], frame.schema).coalesce(1).write.parquet(path + "-none")
    (none,) = found_paths(spark, f"{path}-none/*.parquet")
    conf = spark._jsc.hadoopConfiguration()
    store = none.getFileSystem(conf)
    for n, part in enumerate(parts, 1):
        frame.where(part).coalesce(files).write.mode("append").parquet(path)
        for k in range(len(found_paths(spark, f"{path}/*.parquet")), n * files):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, none, store, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/none-{k}.parquet"), False, conf)
    delete(spark, [path + "-none"])
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).option("cleanSource", "delete").parquet(path)


def quarters(frame, column):
    """Conditions that cut a frame into four parts by ascending values of a column."""
    low, middle, high = frame.approxQuantile(column, [0.25, 0.5, 0.75], 0.01)
    c = F.col(column)
    return [c < low, (c >= low) & (c < middle), (c >= middle) & (c < high), (c >= high) | c.isNull()]


def stream_urls(spark, sf):
    found = links(spark, sf).select("list_url", "url", "page")
    return drain(S.stream_new_urls(streamed(spark, sf, found, "links", quarters(found, "page")).drop("page")), "new-urls")


def stream_seen(spark, sf):
    """Links in four batches, and all of them once more in a fifth, when state has forgotten those before."""
    found = links(spark, sf).select("list_url", "url", "page")
    again = found.select("list_url", "url", F.lit(-1).alias("page"))
    path = new_path(spark, "seen")
    parts = [(F.col("page") >= 0) & p for p in quarters(found, "page")] + [F.col("page") < 0]
    E.stream_seen_urls(streamed(spark, sf, found.unionByName(again), "links", parts), path, path + "-state", "1 millisecond", parts=8).awaitTermination()
    return E.seen_links(spark, path)


def stream_admission(spark, sf):
    events = requests(spark, sf).join(api_keys(spark, sf).drop("bound"), "key", "left").select("key", "event_id", "device", "ts", "is_active", "max_devices", F.unix_micros("ts").alias("at"))
    events = stage(events, "events")  # it is passed over once a part, and to find the parts
    source = streamed(spark, sf, events, "requests", quarters(events, "at")).drop("at")
    delete(spark, [events._staged_at])
    with S.keyed_state(spark):
        return drain(S.stream_admission(source), "admission").select("event_id", "outcome")


def stream_turns(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    with S.keyed_state(spark):
        out = drain(S.stream_recent_turns(streamed(spark, sf, conv, "turns", [F.col("turn") % 3 == k for k in range(3)]), 3), "recent-turns", "update")
    last = out.groupBy("conv_id").agg(F.max_by("turns", "batch").alias("turns"))  # each batch gives the sessions that it touches anew
    return last.select("conv_id", F.explode(F.from_json("turns", "array<array<string>>")).alias("t")).select("conv_id", F.col("t")[0].cast("long").alias("turn"))


def stream_ingest(spark, sf):
    """The incoming articles in four batches, and a fifth in which those of doc_id % 10 = 6 come with another day again, which makes them updates."""
    from gazeloom.plans.views import incoming

    batch = incoming(spark, sf)
    again = batch.where("doc_id % 10 = 6 AND seq % 2 = 0").withColumns({"publish_date": F.lit("2025-01-01").cast("timestamp"), "seq": F.col("seq") + 10**9})
    parts = [F.expr(f"seq < {10**9} AND doc_id % 4 = {k}") for k in range(4)] + [F.col("seq") >= 10**9]
    schema = articles(spark, sf).drop("doc_id").schema
    path = new_path(spark, "table")
    S.stream_ingest(streamed(spark, sf, batch.unionByName(again), "incoming", parts).drop("doc_id"), path, path + "-state", schema, buckets=8).awaitTermination()
    return S.snapshot(spark, path, schema).select("news_id", "url", X.format_date(F.col("publish_date")).alias("day"))


QUERIES = {
    "list_page_urls": page_urls, "extract_links": odd_links, "filter_links": kept_links, "pagination_cut": cut, "incremental_urls": new_urls, "page_metadata": metadata, "strip_html": stripped, "clean_article_markdown": cleaned, "complex_tables": tables_, "absolutize_images": images, "pdf_links": pdfs, "crawl_report": report,
    "vector_ops": vector_ops, "embed_columns": embedded, "embed_tags": tag_embeddings, "match_tags": matched, "merge_tags": merged_tags, "similar_tags": like_tags, "vector_search": nearest, "ann_search": approximate, "semantic_search": semantic, "similar_documents": alike, "similar_documents_all": all_alike, "embed_queries": embedded_queries,
    "article_filter": filtered, "fulltext_search": fulltext, "fulltext_indexed": fulltext_indexed, "simple_text_search": simple_plain, "merge_field_ranks": merged_fields, "fuse_ranks": fused, "hybrid_search": hybrid, "advanced_search": advanced, "keyword_search_any": keyword("any"), "keyword_search_all": keyword("all"), "keyword_search_phrase": keyword("phrase"), "search_results": results, "search_snippets": snippets,
    "latest": lambda s, d: L.latest(articles(s, d), 20, 5).select("news_id"), "oldest": lambda s, d: L.latest(articles(s, d), 20, oldest=True).select("news_id"), "find_articles": found, "count_by_source": lambda s, d: L.count_by_source(articles(s, d)),
    "count_by_date": lambda s, d: L.count_by_date(table(s, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), "month", "at"), "corpus_stats": lambda s, d: L.corpus_stats(articles(s, d)).select("total", "sources", F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("distribution"), X.format_date(F.col("first_date")).alias("first_date"), X.format_date(F.col("last_date")).alias("last_date")),
    "find_tags": named_tags, "trim_observations": observed, "keyword_search_complete": keyword("phrase"), "count_by_category": lambda s, d: L.count_by_category(tags_(s, d)), "tags_by_category": lambda s, d: L.tags_by_category(tags_(s, d), "c1").select("tag_id"), "project_notices": notices, "list_page": paged, "labels": lambda s, d: L.labels(L.project_notices(articles(s, d))), "label_count": lambda s, d: L.label_count(L.project_notices(articles(s, d))), "dashboard": lambda s, d: L.dashboard(L.project_notices(articles(s, d)), keys_(s, d)),
    "list_page_deep": deep_page, "list_submissions": listed_page("submissions", 3, 25, "pending"), "list_registrations": listed_page("registrations", 2, 20, None), "list_users": listed_page("users", 2, 30, True), "list_keys": listed_page("keys", 1, 5, "o3"),
    "submission_ids": ids, "apply_reviews": reviewed, "my_submissions": mine, "apply_registrations": registrations,
    "admission_replay": replay, "usage_totals": usage, "latest_devices": devices, "parse_logs": lambda s, d: logs(s, d).select("ts", "level", "module", "message"), "filter_logs": error_logs, "log_modules": lambda s, d: A.log_modules(logs(s, d)),
    "recent_turns": recent, "trim_by_budget": trimmed, "classify_queries": intents, "infer_time_window": time_windows, "rag_context": rag, "cited_sources": cited,
    "stream_new_urls": stream_urls, "stream_seen_urls": stream_seen, "stream_admission": stream_admission, "stream_recent_turns": stream_turns, "stream_ingest": stream_ingest,
}

TAGGED = "(SELECT 'tag_' || vec_id AS tag_id, 'c' || (label % 3) AS category FROM embeddings WHERE vec_id % 50 = 0)"
NOTICE = f"{ARTICLES}, notices AS (SELECT news_id AS id, source_site AS label, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS date FROM articles)"

ORACLE_SQL = {
    "list_page_urls": "SELECT l AS list_url, CAST(p AS INTEGER) AS page, CASE WHEN p = 1 OR k % 3 = 2 THEN l ELSE 'http://h' || k || '/list' || p || '.htm' END AS page_url FROM (SELECT n_nationkey AS k, 'http://h' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '/list.htm' WHEN 1 THEN '/list7.htm' ELSE '/index' END AS l FROM nation), range(1, 6) r(p)",
    "extract_links": f"WITH {LIST_PAGES} SELECT list_url, page, url FROM links UNION ALL SELECT list_url, page, regexp_extract(list_url, '^[^/]*//[^/?#]*') || unnest(['/q' || page, '/a?x=1&y=\"' || page || '\"']) FROM list_pages",
    "filter_links": f"WITH {LIST_PAGES} SELECT list_url, page, url FROM links WHERE (regexp_matches(url, '/[A-M]') OR regexp_matches(url, '/th')) AND NOT regexp_matches(url, 'ing')",
    "pagination_cut": f"WITH {LIST_PAGES}, f AS (SELECT list_url, url, min(page) AS page FROM links GROUP BY ALL), stop AS (SELECT list_url, min(page) AS stop FROM list_pages p WHERE NOT success OR (page > 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.list_url = p.list_url AND f.page = p.page)) GROUP BY ALL) SELECT list_url, url FROM f LEFT JOIN stop USING (list_url) WHERE stop IS NULL OR page < stop",
    "incremental_urls": f"WITH {LIST_PAGES}, d AS (SELECT DISTINCT list_url, url FROM links), o AS (SELECT DISTINCT list_url, url FROM links WHERE page = 1) SELECT list_url, count(*) FILTER ((list_url, url) NOT IN (SELECT (list_url, url) FROM o)) AS n, count(*) AS seen FROM d GROUP BY ALL",
    "strip_html": STRIPPED_SQL,
    "page_metadata": METADATA_SQL,
    "complex_tables": TABLES_SQL,
    "clean_article_markdown": CLEANED_SQL,
    "absolutize_images": f"SELECT page_id, '![a$1](' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/_upload/' || page_id || '.png) ![b](/other/x.png) ![c](http://z/y.png)' AS md FROM pages",
    "pdf_links": "SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/_upload/f ' || page_id || '.pdf' AS url, 'f ' || page_id AS label FROM pages",
    "crawl_report": f"WITH {LIST_PAGES} SELECT list_url, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, {HOST.format('list_url')} AS source FROM list_pages GROUP BY ALL",
    "vector_ops": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), j AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, q FROM embeddings, q) SELECT vec_id, round(list_cosine_similarity(a, q), 6) AS cosine, round(list_distance(a, q), 6) AS distance, round(1 - least(list_distance(a, q) / sqrt(2), 1), 6) AS similarity, CAST(1.0 AS DOUBLE) AS length, round(0.3 * list_inner_product(a, q) + 0.7 * list_inner_product(q, q), 6) AS mixed FROM j",
    "embed_columns": EMBED_SQL,
    "embed_tags": EMBED_TAGS_SQL,
    "find_tags": NAMED_SQL,
    "match_tags": matches_sql(TAGGED_FROM, 5, "true"),
    "merge_tags": f"WITH {ARTICLES}, m AS ({matches_sql(TAGGED_FROM, 5, 'true')}), g AS (SELECT news_id AS doc_id, list(tag_id ORDER BY rank) AS t FROM m GROUP BY ALL) SELECT news_id, array_to_string(list_concat(tags, coalesce(t, [])), ',') AS tags FROM articles LEFT JOIN g USING (doc_id)",
    "similar_tags": matches_sql(0.2, 3, "true"),
    "vector_search": nearest_sql("q.vec_id % 50 = 0", 10),
    "semantic_search": nearest_sql("q.vec_id % 50 = 0", 10, threshold=0.3),
    "similar_documents_all": nearest_sql("true", 5, "q.vec_id <> c.vec_id"),
    "embed_queries": f"""WITH w AS (SELECT item_id AS id, {words_sql(f"'{V.QUERY_PREFIX}' || text")} AS w FROM benchmark), v AS ({value_sums_sql(vector_sql("w", 256), "sum")}) SELECT id AS query_id, 256 AS width, sum_a, sum_b FROM v""",
    "similar_documents": nearest_sql("q.vec_id % 25 = 0", 5, "q.vec_id <> c.vec_id"),
    "article_filter": f"WITH {ARTICLES} SELECT news_id FROM articles WHERE source_site = 'src3' AND author IN ('en', 'fr') AND publish_date BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-11-30' AND crawl_version >= 2",
    "fulltext_search": f"WITH {BM25} SELECT query_id, news_id, round(s, 5) AS score FROM text_hits WHERE rank <= 10",
    "fulltext_indexed": f"WITH {BM25} SELECT query_id, news_id, round(s, 5) AS score FROM text_hits WHERE rank <= 10",
    "simple_text_search": SIMPLE_SQL,
    "merge_field_ranks": f"WITH {BM25}, {TWENTY}, {VECTOR_HITS}, p AS (SELECT query_id, news_id, 0.3 / rank AS t, 0.0 AS c FROM th UNION ALL SELECT query_id, news_id, 0.0, 0.7 / rank FROM vector_hits) SELECT query_id, news_id, round(sum(t) + sum(c), 6) AS score, round(sum(t), 6) AS title_score FROM p GROUP BY ALL",
    "fuse_ranks": f"WITH {BM25}, {TWENTY}, {VECTOR_HITS}, {FUSE.format(v='vector_hits')} SELECT query_id, news_id, round(s, 6) AS score, rank FROM ranked WHERE rank <= 10",
    "hybrid_search": f"{HYBRID} SELECT query_id, news_id, round(s, 6) AS score, rank FROM hybrid",
    "advanced_search": f"{HYBRID} SELECT h.query_id, h.news_id, round(0.6 * (0.3 * coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(list_reverse(c.embedding) AS DOUBLE[])), 0) + 0.7 * coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 0)) + 0.4 * h.s, 5) AS score FROM hybrid h LEFT JOIN embeddings q ON q.vec_id = h.query_id LEFT JOIN embeddings c ON 'doc_' || c.vec_id = h.news_id",
    "keyword_search_any": keyword_sql("any"),
    "keyword_search_all": keyword_sql("all", None),
    "keyword_search_phrase": keyword_sql("phrase", None),
    "keyword_search_complete": keyword_sql("phrase", 1_000_000_000),
    "search_results": f"WITH {ARTICLES}, {VECTOR_HITS} SELECT query_id, rank, h.news_id, source_site AS label, coalesce(meta_url, url) AS detail_url, is_page, round(s, 6) AS similarity_score, round(greatest(0, 1 - s), 6) AS distance FROM vector_hits h JOIN articles a ON a.news_id = h.news_id WHERE rank <= 10 AND s >= 0.3",
    "search_snippets": f"WITH {ARTICLES} SELECT news_id, {snip_sql(220)} AS summary, md5({snip_sql(1000)}) AS content_md5, length(content_text) > 1000 AS content_truncated, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS published_date FROM articles",
    "latest": f"WITH {ARTICLES} SELECT news_id FROM articles ORDER BY publish_date DESC NULLS LAST, news_id LIMIT 20 OFFSET 5",
    "oldest": f"WITH {ARTICLES} SELECT news_id FROM articles ORDER BY publish_date ASC NULLS LAST, news_id LIMIT 20",
    "find_articles": f"WITH {ARTICLES} SELECT news_id FROM articles WHERE author = 'en' AND source_site IN ('src1', 'src2', 'src5') ORDER BY publish_date DESC NULLS LAST, news_id LIMIT 15",
    "count_by_source": f"WITH {ARTICLES} SELECT source_site, count(*) AS n FROM articles GROUP BY ALL",
    "count_by_date": "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS period, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL",
    "corpus_stats": f"WITH {ARTICLES} SELECT count(*) AS total, count(DISTINCT source_site) AS sources, (SELECT string_agg(s || ':' || n, ',' ORDER BY s) FROM (SELECT source_site AS s, count(*) AS n FROM articles GROUP BY ALL)) AS distribution, strftime(min(publish_date), '%Y-%m-%d') AS first_date, strftime(max(publish_date), '%Y-%m-%d') AS last_date FROM articles",
    "count_by_category": f"SELECT category, count(*) AS n FROM {TAGGED} GROUP BY ALL",
    "tags_by_category": f"SELECT tag_id FROM {TAGGED} WHERE category = 'c1'",
    "project_notices": f"WITH {ARTICLES} SELECT news_id AS id, CASE WHEN doc_id % 2 = 1 THEN source_site WHEN doc_id % 35 = 10 THEN 'm9' ELSE coalesce(meta_label, CASE WHEN doc_id % 14 = 0 THEN '' ELSE source_site END) END AS label, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS date, CASE WHEN doc_id % 35 = 10 THEN url ELSE coalesce(meta_url, url) END AS detail_url, is_page AND doc_id % 35 <> 10 AS is_page, '[]' AS attachments FROM articles WHERE doc_id % 31 <> 0",
    "list_page": f"WITH {NOTICE} SELECT id, label, date, (SELECT count(*) FROM notices) AS total FROM notices ORDER BY date DESC, id DESC LIMIT 20 OFFSET 20",
    "list_page_deep": f"WITH {NOTICE} SELECT id, label, date, total FROM (SELECT *, row_number() OVER (ORDER BY date DESC, id DESC) AS n, count(*) OVER () AS total FROM notices) WHERE n > (total // 20 - 1) * 20 AND n <= total // 20 * 20",
    "list_submissions": "WITH s AS (SELECT 's' || doc_id AS id, left(text, 25) AS title, CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 40 AS INTEGER), '%Y-%m-%d') END AS date, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS status FROM documents) SELECT *, (SELECT count(*) FROM s WHERE status = 'pending') AS total FROM s WHERE status = 'pending' ORDER BY date DESC NULLS LAST, id DESC LIMIT 25 OFFSET 50",
    "list_registrations": "SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 9 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) END AS created_at, CASE WHEN c_custkey % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20",
    "list_users": "SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 9 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) END AS created_at, true AS is_active, (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0) AS total FROM customer WHERE c_custkey % 4 <> 0 ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 30 OFFSET 30",
    "list_keys": f"WITH {REQUESTS}, k AS (SELECT key, 'o' || (CAST(key AS INTEGER) % 10) AS owner, DATE '2024-01-01' + CAST(CAST(key AS INTEGER) % 7 AS INTEGER) AS created_at FROM keys) SELECT *, (SELECT count(*) FROM k) AS total FROM k WHERE owner = 'o3' ORDER BY created_at DESC, key DESC LIMIT 5",
    "labels": f"WITH {NOTICE} SELECT DISTINCT label FROM notices",
    "label_count": f"WITH {NOTICE} SELECT count(DISTINCT label) AS n FROM notices",
    "dashboard": f"WITH {REQUESTS} SELECT (SELECT count(*) FROM documents) AS total_notices, (SELECT count(*) FROM keys WHERE is_active) AS active_keys, (SELECT count(*) FROM replay WHERE outcome = 'accepted') AS total_calls",
    "submission_ids": "WITH d AS (SELECT doc_id AS seq, sha256(left(text, 25) || '2024-04-05' || CASE WHEN doc_id % 3 = 0 THEN 'http://s/' || (doc_id % 50) ELSE '' END) AS submission_id, CAST(greatest(length(source), length(left(text, 25)), CASE WHEN doc_id % 3 = 0 THEN length('http://s/' || (doc_id % 50)) ELSE 0 END, length(text), 2) AS INTEGER) AS size FROM documents) SELECT submission_id, seq, size FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY seq) AS n FROM d WHERE size <= 10000) WHERE n = 1",
    "apply_reviews": REVIEWS_SQL,
    "my_submissions": "SELECT doc_id AS seq, left(text, 25) AS title FROM documents WHERE doc_id % 20 = 7",
    "apply_registrations": REGISTRATIONS_SQL,
    "admission_replay": f"WITH {REQUESTS} SELECT event_id, outcome FROM replay",
    "usage_totals": f"WITH {REQUESTS} SELECT key, count(*) AS requests, array_to_string(list_sort(list(DISTINCT device)), ',') AS devices FROM replay WHERE outcome = 'accepted' GROUP BY ALL",
    "latest_devices": f"WITH {REQUESTS} SELECT key AS user_id, device, max((ts, event_id))[2] AS event_id, count(*) AS logins FROM requests WHERE event_type = 'signup' GROUP BY ALL",
    "parse_logs": f"WITH {LOGS} SELECT ts, level, module, message FROM logs",
    "filter_logs": f"WITH {LOGS} SELECT module, message FROM logs WHERE level = 'ERROR' AND contains(lower(message), 'signup')",
    "log_modules": f"WITH {LOGS} SELECT DISTINCT module FROM logs",
    "recent_turns": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "trim_observations": "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(CAST(to_json({'turn': turn, 'role': role, 'text': text}) AS VARCHAR)) + 5) OVER w AS s, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE s <= 700 OR n = 1",
    "trim_by_budget": "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(coalesce(role, '')) + length(coalesce(text, ''))) OVER w AS s, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE s <= 500 OR n = 1",
    "classify_queries": INTENT_SQL,
    "infer_time_window": WINDOW_SQL,
    "rag_context": f"""WITH {ARTICLES}, {VECTOR_HITS}, q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT -1 - vec_id FROM embeddings WHERE vec_id % 150 = 0),
c AS (SELECT query_id, '资讯标题：' || title || chr(10) || '资讯正文：' || content_text || chr(10) || '资讯日期：' || coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS c FROM q JOIN articles a ON a.doc_id = q.query_id + 3 WHERE query_id % 100 = 0 AND query_id >= 0),
h AS (SELECT h.query_id, string_agg(rank || '. 标题：' || title || chr(10) || '日期：' || coalesce(strftime(publish_date, '%Y-%m-%d'), '') || chr(10) || '链接：' || url || chr(10) || '正文：' || CASE WHEN length(content_text) > 180 THEN left(content_text, 180) || '...' ELSE content_text END, chr(10) || chr(10) ORDER BY rank) AS h
  FROM vector_hits h JOIN articles a ON a.news_id = h.news_id LEFT JOIN c ON c.query_id = h.query_id WHERE rank <= CASE WHEN c.query_id IS NULL THEN 10 ELSE 3 END GROUP BY ALL)
SELECT q.query_id, md5(coalesce(c || chr(10) || chr(10), '') || coalesce(h, '未检索到相关资讯。')) AS context_md5 FROM q LEFT JOIN c USING (query_id) LEFT JOIN h USING (query_id)""",
    "cited_sources": "SELECT session, string_agg(url, ' ' ORDER BY pos) AS urls FROM (SELECT user_id AS session, 'http://' || event_type || '/' || (event_id % 5) AS url, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY ALL",
    "stream_new_urls": f"WITH {LIST_PAGES} SELECT DISTINCT list_url, url FROM links",
    "stream_seen_urls": f"WITH {LIST_PAGES} SELECT DISTINCT list_url, url FROM links",
    "stream_admission": f"WITH {REQUESTS} SELECT event_id, outcome FROM replay",
    "stream_ingest": f"{INGEST}, kept AS (SELECT t.* FROM titled t JOIN valid v USING (seq) WHERE NOT v.dup) SELECT news_id, url, CASE WHEN doc_id % 10 = 6 THEN '2025-01-01' ELSE coalesce(strftime(publish_date, '%Y-%m-%d'), '') END AS day FROM (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY seq DESC) AS n FROM kept) WHERE n = 1",
    "stream_recent_turns": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
}

