"""Scalar functions on text, dates and URLs as Spark columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats of dates in the order in which they are tried, as Spark patterns (fixed values).
DATE_FORMATS = (
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:sXX",
    "yyyy-M-d'T'H:m:s.SSSSSSXXX",
    "yyyy-M-d'T'H:m:s.SSSXXX",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
    "yyyy/M/d H:m:s",
    "yyyy/M/d H:m",
    "yyyy/M/d",
    "d/M/yyyy",
    "M/d/yyyy",
)
#: Marks that end a sentence, and the marks at which a long title is cut, in order (fixed values).
SENTENCE_END = r"[。！？?!\.…]+"
CUTS = ("。", "！", "？", "!", "?", ".", "，", ",", "；", ";")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


#: White space of any kind, the control characters that part records among it.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Text without white space of any kind at its edges."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def blank(c: Column) -> Column:
    """Whether text is empty or white space alone; null for null."""
    return ~c.rlike(rf"(?U)[^\s\x1c-\x1f]")


def normalize_datetime(c: Column) -> Column:
    """Text as a UTC timestamp; Chinese date and time words are rewritten first; null where no format fits."""
    c = strip(c)
    c = F.regexp_replace(c, r"(\d{4})年(\d{1,2})月(\d{1,2})日", "$1-$2-$3")
    c = F.regexp_replace(c, r"(\d{1,2})时(\d{1,2})分(\d{1,2})秒?", "$1:$2:$3")
    c = F.regexp_replace(c, r"(\d{1,2})时(\d{1,2})分", "$1:$2:00")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def format_date(c: Column) -> Column:
    """Timestamp as YYYY-MM-DD, null as the empty string."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def safe_date(c: Column) -> Column:
    """The first ten characters of text that looks like an ISO date, other text as it is, null as the empty string."""
    return F.when(c.isNull(), "").when(c.rlike(r"^.{4}-.{2}-"), F.left(c, F.lit(10))).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def truncate(c: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - len(suffix))), F.lit(suffix))).otherwise(c)


@F.pandas_udf(T.StringType())
def _composed(c: pd.Series) -> pd.Series:
    """NFC form with HTML entities decoded; Spark has neither."""
    import html
    import unicodedata

    return c.map(lambda x: None if x is None else html.unescape(unicodedata.normalize("NFC", x)))


def clean_text(c: Column, n: int | None = None) -> Column:
    """Composed characters, plain line ends, decoded entities, single spaces; cut to n characters on wish. Null gives ''."""
    c = F.coalesce(c, F.lit(""))
    needs = c.rlike(r"[&\x{80}-\x{10FFFF}]")  # plain ASCII without entities stays on the JVM
    c = F.when(needs, _composed(c)).otherwise(c)
    c = collapse(F.regexp_replace(c, "\r\n?", "\n"))
    return truncate(c, n) if n else c


#: What becomes of the marks of markdown, in order (fixed values; code goes first, so that marks in it do not count).
MARKDOWN_MARKS = (
    (r"```[\s\S]*?```", ""),
    (r"`[^`]+`", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^#+\s*", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"(?m)^>\s*", ""),
    (r"(?m)^[*\-+]\s+", ""),
    (r"(?m)^\d+\.\s+", ""),
    (r"(?m)^[-*_]{3,}$", ""),
)


def markdown_to_text(c: Column) -> Column:
    """Text of markdown: code goes first, then images and links keep their words and the remaining marks go."""
    c = F.coalesce(c, F.lit(""))
    for pattern, to in MARKDOWN_MARKS:
        c = F.regexp_replace(c, pattern, to)
    return collapse(c)


#: Faults of markdown that show within or across lines, and what becomes of them, in order (fixed values).
MARKDOWN_FAULTS = (
    (r"\*\*[ \t\r\n]*\*\*", ""),
    (r"!\[\]([^\[\n]*)\[", "![]$1 ["),
    (r"(?<!\*)\*{4,}(?!\*)", ""),
    (r"\*{4,}", "**"),
    (r"\*\*([^*]+)\*\*\|", "$1|"),
    (r"(?U)\*\*([^*]+)\*\*(\s*\z)", "$1$2"),
    (r"(?U)(\|\s*){4,}", ""),
)


def _barred(line: Column) -> Column:
    """A line with bars and dashes gets the bars that it lacks at its edges."""
    opened = F.when(line.startswith("|"), line).otherwise(F.concat(F.lit("|"), line))
    cut = F.regexp_replace(opened, rf"(?U){SPACE}+\z", "")
    return F.when(line.contains("|") & line.contains("-"), F.when(cut.endswith("|"), opened).otherwise(F.concat(cut, F.lit("|")))).otherwise(line)


def _without_rules(lines: Column) -> Column:
    """Each run of lines that hold nothing but dashes, colons and white space becomes one empty line."""
    bare = F.transform(lines, lambda line: ~line.rlike(r"(?U)[^-:\s\x1c-\x1f]"))
    return let(bare, lambda bare: _first_of_runs(lines, bare))


def _first_of_runs(lines: Column, bare: Column) -> Column:
    after = F.concat(F.array(F.lit(False)), F.slice(bare, F.lit(1), F.size(bare) - 1))
    rows = F.zip_with(F.arrays_zip(lines.alias("line"), bare.alias("bare")), after, lambda x, before: F.struct(F.when(x["bare"], "").otherwise(x["line"]).alias("line"), (x["bare"] & before).alias("repeated")))
    return F.transform(F.filter(rows, lambda x: ~x["repeated"]), lambda x: x["line"])


def _line_kind(line: Column) -> Column:
    """text, or flow for a line that stays as it is and that text may follow, or break for one after which text needs no blank line."""
    return let(strip(line), _kind_of_stripped)


def _kind_of_stripped(s: Column) -> Column:
    cells = s.contains("|") & s.rlike(r"[^\s|:-]")
    breaks = (s == "") | s.startswith("![") | s.startswith("|")
    return F.when(breaks, "break").when(cells | s.startswith("#") | s.startswith("- [") | s.startswith("```"), "flow").otherwise("text")


def repair_markdown(c: Column) -> Column:
    """Markdown with frequent faults mended: stray stars, bold cells, images that touch links, runs of bars, missing bars of separator lines, lone rules and runs of blank lines,
    and a blank line between consecutive lines of text. Lines are those between line feeds. Null stays null."""
    for pattern, to in MARKDOWN_FAULTS:
        c = F.regexp_replace(c, pattern, to)
    lines = let(F.transform(F.split(c, "\n", -1), _barred), _without_rules)
    return let(lines, lambda found: let(F.transform(found, _line_kind), lambda kinds: F.array_join(_spaced(found, kinds), "\n")))


def _spaced(lines: Column, kinds: Column) -> Column:
    """Lines with a line feed before each line of text that follows text or flow."""
    previous = F.concat(F.array(F.lit("break")), F.slice(kinds, F.lit(1), F.size(kinds) - 1))
    apart = F.zip_with(kinds, previous, lambda now, before: (now == "text") & (before != "break"))
    return F.zip_with(lines, apart, lambda line, gap: F.when(gap, F.concat(F.lit("\n"), line)).otherwise(line))


def first_sentence_title(c: Column, n: int = 100) -> Column:
    """The first heading, or else the text up to its first sentence end; what is longer is cut."""
    text = F.coalesce(c, F.lit(""))

    def cut(head: Column) -> Column:
        marked = F.filter(F.array(*[F.lit(d) for d in CUTS]), lambda d: F.contains(head, d))
        return F.when(F.size(marked) == 0, F.concat(head, F.lit("..."))).otherwise(let(marked[0], lambda d: F.left(head, F.length(head) - F.length(_after_last(head, d)))))

    def from_sentence(sentence: Column) -> Column:
        return F.when(F.length(sentence) > n, let(F.left(sentence, F.lit(n)), cut)).otherwise(sentence)

    heading = let(markdown_to_text(F.regexp_extract(text, r"(?m)^#+\s*(\S.*?)$", 1)), lambda h: truncate(h, n))
    sentence = let(collapse(F.regexp_extract(markdown_to_text(text), rf"(?s)^.*?(?:{SENTENCE_END}|\z)", 0)), from_sentence)
    return let(heading, lambda h: F.when(h != "", h).otherwise(sentence))


def _after_last(c: Column, mark: Column) -> Column:
    """What follows the last occurrence of a mark."""
    return F.element_at(F.split(c, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))), -1)


def title_from_content(c: Column) -> Column:
    """A title in 【】 among the first five lines, or a heading among the first three, or the first sentence; '' if there is none."""
    text = F.coalesce(c, F.lit(""))

    def longer(found: Column, least: int) -> Column:
        return F.when(F.length(strip(found)) > least, strip(found))

    def from_lines(lines: Column) -> Column:
        titled = F.transform(F.slice(lines, 1, 5), lambda x: F.coalesce(longer(F.regexp_extract(x, r"【[^】]+】(.+)", 1), 2), longer(F.regexp_extract(x, r"【(.+)】", 1), 3)))
        headed = F.transform(F.slice(lines, 1, 3), lambda x: F.when(F.startswith(x, F.lit("#")), longer(F.regexp_replace(x, r"^#+\s*", ""), 2)))
        return F.try_element_at(F.array_compact(F.concat(titled, headed)), F.lit(1))

    first = let(strip(F.regexp_extract(text, r"(?s)^[^。.]*", 0)), lambda x: F.when((x == "") | F.startswith(x, F.lit("![")), "").when(F.length(x) > 100, F.concat(F.left(x, F.lit(100)), F.lit("..."))).otherwise(x))
    lines = F.transform(F.split(strip(text), "\n"), strip)
    return F.coalesce(let(lines, from_lines), first)


def date_from_content(c: Column) -> Column:
    """The first date in Chinese words, or ''."""
    return F.coalesce(F.regexp_extract(c, r"(\d{1,2}年)?\d{1,2}月\d{1,2}[日号]", 0), F.lit(""))


def normalize_url(c: Column) -> Column:
    """Lower case, without edges of white space, slashes at the end, tracking parameters and a bare question mark."""
    c = F.regexp_replace(strip(F.lower(c)), r"/+\z", "")
    c = F.regexp_replace(c, r"[?&](utm_\w+|ref|source|from)=[^&]*", "")
    return F.coalesce(F.regexp_replace(c, r"\?\z", ""), F.lit(""))


def url_hash(c: Column) -> Column:
    """MD5 of the normalised URL; '' for none."""
    c = normalize_url(c)
    return F.when(c == "", "").otherwise(F.md5(c))


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash (as a signed long): each occurrence of a token of two or more characters votes by the bits of its MD5's last eight bytes."""
    import hashlib
    import re
    from collections import Counter

    import numpy as np

    marks = re.compile(r"[^\w\s]")
    known: dict[str, int] = {}
    out = []
    for text in texts:
        counts = Counter(t for t in marks.sub(" ", text or "").split() if len(t) >= 2)
        if not counts:
            out.append(0)
            continue
        for token in counts:
            if token not in known:
                if len(known) > 200_000:
                    known.clear()
                known[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")
        # A token can have been forgotten within this text only if the text alone holds very many.
        values = np.array([known.get(t) if t in known else int.from_bytes(hashlib.md5(t.encode()).digest()[8:], "big") for t in counts], np.uint64)
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        votes = ((2 * bits - 1) * np.array(list(counts.values()))[:, None]).sum(0)
        out.append(int(np.packbits(votes > 0).view(">u8")[0].astype(np.uint64).astype(np.int64)))
    return pd.Series(out, dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def absolutize_images(md: Column, url: Column) -> Column:
    """Uploaded images of markdown with the page's scheme and host before their path."""
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    to = F.concat(F.lit("![$1]("), F.regexp_replace(base, r"([\\$])", r"\\$1"), F.lit("$2)"))
    return F.when(base == "", md).otherwise(F.regexp_replace(md, F.lit(r"!\[([^\]]*)\]\((/_upload/[^)]+)\)"), to))


#: Words by which a query is sorted (fixed values).
LINK_WORDS = ("链接", "网址", "网页", "url", "http")
VERIFY_WORDS = ("核验", "真伪")
COUNT_WORDS = ("统计", "数量", "多少", "count", "筛选", "占比")
DETAIL_WORDS = ("详情", "全文", "原文", "附件")
RECENT_WORDS = ("近期", "最近", "最新", "recent")


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def classify_query(c: Column) -> Column:
    """link_verification, statistics, detail or fuzzy_qa, by the first rule that fits."""
    c = strip(c)
    low = F.lower(c)
    link = c.rlike(r"https?://\S+") | (has_any(low, LINK_WORDS) & has_any(low, VERIFY_WORDS))
    detail = c.rlike(r"(?U)\b[0-9]{6,8}[_-][A-Za-z0-9_-]+\b") | has_any(low, DETAIL_WORDS)
    return F.when(link, "link_verification").when(has_any(low, COUNT_WORDS), "statistics").when(detail, "detail").otherwise("fuzzy_qa")


def infer_time_window(c: Column, as_of: Column) -> Column:
    """Struct of label, start_date and end_date (texts with time) that a query asks for by words; null if it doesn't."""
    low = F.lower(strip(c))
    pattern = r"近\s*(\d{1,3})\s*(天|日|周|星期|个月|月)"
    n = F.greatest(F.try_to_number(F.regexp_extract(low, pattern, 1), F.lit("999")).cast("int"), F.lit(1))
    unit = F.regexp_extract(low, pattern, 2)
    name = F.when(unit.isin("天", "日"), "天").when(unit.isin("周", "星期"), "周").otherwise("月")
    days = n * F.when(name == "天", 1).when(name == "周", 7).otherwise(30)

    def window(label: Column, start: Column) -> Column:
        return F.struct(label.alias("label"), F.concat(start.cast("string"), F.lit("T00:00:00")).alias("start_date"), F.concat(as_of.cast("string"), F.lit("T23:59:59")).alias("end_date"))

    return (
        F.when(unit != "", window(F.concat(F.lit("近"), n.cast("string"), name), F.date_sub(as_of, days - 1)))
        .when(c.contains("本周"), window(F.lit("本周"), F.trunc(as_of, "week")))
        .when(c.contains("本月"), window(F.lit("本月"), F.trunc(as_of, "month")))
        .when(has_any(low, RECENT_WORDS), window(F.lit("近期(近30天)"), F.date_sub(as_of, 29)))
    )


def snippet(c: Column, n: int) -> Column:
    """At most n characters of the trimmed text, with an ellipsis where it was cut."""
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.left(c, F.lit(n)), rf"(?U){SPACE}+\z", ""), F.lit("…"))).otherwise(c)
