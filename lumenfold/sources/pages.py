"""Facts that pages and plain texts state about themselves, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.identity import source_id


def html_title(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def html_canonical(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"""(?i)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["']""", 1), F.lit(""))


def html_lang(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"""(?i)<html[^>]*\slang=["']([A-Za-z-]+)["']""", 1), F.lit(""))


def normal_text(text: Column) -> Column:
    """CRLF to LF, runs of spaces and tabs to one space and none at line ends, at most one blank line in a row."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def text_title(text: Column) -> Column:
    """First line with visible text, heading marks stripped, at most 200 characters."""
    first = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\s]", "") != ""), F.lit(1))
    return F.left(F.trim(F.regexp_replace(F.trim(F.regexp_replace(first, r"[\r\t]", " ")), "^#+ *", "")), F.lit(200))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def html_meta(body: Column, *names: str) -> Column:
    """Content of the first meta element of one of these names or properties, or null."""
    of = lambda n: F.nullif(F.regexp_extract(body, rf"""(?i)<meta[^>]*(?:name|property)=["']{n}["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))
    return F.coalesce(*map(of, names))


def visible(body: Column) -> Column:
    """A page's text without tags, scripts, styles, head and comments."""
    return F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style|head)[^>]*>.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")


def ingest(pages: DataFrame) -> DataFrame:
    """Distinct fetched pages with ``outcome``, the id of the source they are captured as, title and number of words; pages
    that could not be ingested keep their row and say why."""
    p = page_status(pages.filter("fetch_id is not null").distinct())
    ok = F.col("outcome") == "ok"
    sid = source_id(F.lit(None).cast("string"), F.col("final_url"), F.sha2("body", 256))
    return p.withColumn("source_id", sid).withColumn("title", F.when(ok, html_title(F.col("body")))).withColumn("words", F.when(ok, word_count(visible(F.col("body")))))


def page_status(pages: DataFrame, min_words: int = 50) -> DataFrame:
    """Typed outcome per fetched page: ``no_content``, ``http_error``, ``not_text``, ``too_short`` or ``ok``."""
    status = (
        F.when(F.col("body").isNull() | (F.col("body") == ""), "no_content").when(F.col("http_status") != 200, "http_error")
        .when(~F.coalesce(F.col("content_type"), F.lit("")).startswith("text/"), "not_text").when(word_count(visible(F.col("body"))) < min_words, "too_short").otherwise("ok")
    )
    return pages.withColumn("outcome", status)
