import pytest
from pyspark.sql import functions as F

from gazeloom.functions import html as H
from gazeloom.functions import text as X


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://A.b/C", "http://a.b/c"), (" http://a/b// ", "http://a/b"), ("http://a/b?utm_source=x", "http://a/b"), ("http://a/b?", "http://a/b"), ("http://a/b?id=1&ref=2", "http://a/b?id=1"), ("http://a/b?ref=2&id=1", "http://a/b&id=1"), (None, "")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, X.normalize_url, url) == want


def test_url_hash(spark):
    assert one(spark, X.url_hash, "") == ""
    assert one(spark, X.url_hash, "http://A/b/") == one(spark, X.url_hash, "http://a/b")
    assert len(one(spark, X.url_hash, "http://a")) == 32


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024年5月2日", "2024-05-02 00:00:00"), ("2024年5月2日 9时05分", "2024-05-02 09:05:00"), ("2024-05-20T10:30:00", "2024-05-20 10:30:00"), ("2024-05-20T10:30:00+08:00", "2024-05-20 02:30:00"), ("2024/05/20 10:30", "2024-05-20 10:30:00"), ("03/02/2024", "2024-02-03 00:00:00"), ("13/02/2024", "2024-02-13 00:00:00"), ("02/13/2024", "2024-02-13 00:00:00"), ("soon", None), ("", None), (None, None)],
)
def test_normalize_datetime(spark, text, want):
    assert one(spark, lambda c: F.date_format(X.normalize_datetime(c), "yyyy-MM-dd HH:mm:ss"), text) == want


def test_simhash(spark):
    assert one(spark, lambda c: X.simhash(c), "") == 0
    assert one(spark, lambda c: X.simhash(c), "a b c") == 0
    assert one(spark, lambda c: X.simhash(c), "some words here") == one(spark, lambda c: X.simhash(c), "here, some words!")
    assert spark.sql("select bit_count(15L ^ 15L), bit_count(15L ^ 0L)").first()[:] == (0, 4)


def test_clean_text(spark):
    assert one(spark, X.clean_text, " a\r\nb &amp; é ") == "a b & é"
    assert one(spark, X.clean_text, None) == ""
    assert one(spark, lambda c: X.clean_text(c, 5), "abcdefgh") == "ab..."


def test_markdown(spark):
    assert one(spark, X.markdown_to_text, "# T\n**b** [l](u) `x`\n```\ncode\n```\n> q\n- i\n1. n\n---\n") == "T b l q i n"
    assert one(spark, X.repair_markdown, "a****b") == "ab"
    assert one(spark, X.repair_markdown, "one\ntwo\n\n# h\nthree") == "one\n\ntwo\n\n# h\n\nthree"
    assert one(spark, X.repair_markdown, "| a | b |\n-|-\n| 1 | 2 |") == "| a | b |\n|-|-|\n| 1 | 2 |"
    assert one(spark, X.repair_markdown, "x\n---\ny") == "x\n\ny"


def test_titles(spark):
    assert one(spark, X.first_sentence_title, "text\n# The **head**\nmore") == "The head"
    assert one(spark, X.first_sentence_title, "第一句。第二句") == "第一句。"
    assert one(spark, X.first_sentence_title, "") == ""
    assert one(spark, X.first_sentence_title, "a" * 120) == "a" * 100 + "..."
    assert one(spark, X.first_sentence_title, "ab, " + "c" * 120) == "ab,"
    assert one(spark, X.title_from_content, "x\n【类】The title") == "The title"
    assert one(spark, X.title_from_content, "【a long one】") == "a long one"
    assert one(spark, X.title_from_content, None) == ""
    assert one(spark, X.date_from_content, "在24年5月28日开") == "24年5月28日"


def test_html(spark):
    page = '<html><head><title>T</title><style>x{}</style></head><body><h1> A <b>b</b></h1><div class="date new">2024</div><p class=writer>Me</p><script>no</script></body></html>'
    assert one(spark, lambda c: H.strip_html(c), page) == "T A b 2024 Me"
    assert one(spark, lambda c: H.page_metadata(c), page)[:] == ("Ab", "2024", "Me")
    assert one(spark, lambda c: H.page_metadata(c), None)[:] == ("", "", "")
    table = '<table class="x"><tr><td rowspan="2" onclick="f()">a</td><td><img src="i/icon_doc.gif"></td></tr></table><table><tr><td>b</td></tr></table>'
    assert one(spark, lambda c: H.complex_tables(c), table) == ['<table><tr><td rowspan="2">a</td><td></td></tr></table>']
    frame = '<iframe class="wp_pdf_player" title="Name" src="/v/viewer.html?file=/f%20a.pdf&x"></iframe>'
    assert one(spark, lambda c, u: H.pdf_links(c, u), frame, "http://h/p")[0][:] == ("http://h/f a.pdf", "Name")
    assert one(spark, H.clean_article_markdown, "|--|\nTitle\n2024\n\nbody\n2024\n|  | a\n| b\n| c\n| d\n| e\nend", "Title", "2024") == "body\nend"
    assert one(spark, H.clean_article_markdown, None, None, None) == ""


@pytest.mark.parametrize(("query", "want"), [("看 http://a/b", "link_verification"), ("这个链接的真伪", "link_verification"), ("真伪", "fuzzy_qa"), ("有多少", "statistics"), ("20240101-ab", "detail"), ("hello", "fuzzy_qa")])
def test_classify_query(spark, query, want):
    assert one(spark, X.classify_query, query) == want


def test_time_window(spark):
    day = F.lit("2024-02-01").cast("date")
    assert one(spark, lambda c: X.infer_time_window(c, day), "近0天")[:] == ("近1天", "2024-02-01T00:00:00", "2024-02-01T23:59:59")
    assert one(spark, lambda c: X.infer_time_window(c, day), "本周")[1] == "2024-01-29T00:00:00"
    assert one(spark, lambda c: X.infer_time_window(c, day), "x") is None
