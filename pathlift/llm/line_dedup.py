"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

For each host, the pages that contain a line are divided by all pages of the host; lines above a ratio are dropped.
Counts are combined before the shuffle, lines travel as 16-byte digests, and a page counts a line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

RATIO = 0.2
#: A line must be on so many pages of its host, so that hosts with few pages keep their lines.
LEAST_PAGES = 3
#: Patterns that turn a page into lines (also used by the SQL that checks the query).
UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|div|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
SPACES = r"[ \t\r\f]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; null if there is none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def html_text(html: Column) -> Column:
    """Visible text, a line for each block."""
    text = F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def lines_of(text: Column) -> Column:
    """Lines with single spaces, without empty ones."""
    tidy = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.filter(tidy, lambda x: x != "")


def cleaned(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES,
            keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the kept columns, all by default), host, n_lines, n_kept, text.

    Rows are pages: repeated rows count as pages of their own. A page without a host belongs to no site and keeps all
    lines; a null text has no lines and gives an empty text. An empty table gives no rows. Input columns live inside
    ``row`` and cannot clash.
    """
    columns = df.columns if keep is None else keep
    pages = cut_lineage(df.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(c) for c in columns]).alias("row"),
        host.alias("host"), F.coalesce(lines_of(text), F.array().cast("array<string>")).alias("lines")))
    digest = F.unhex(F.md5("line"))
    lines = pages.where("host is not null").select(
        "rid", "host", F.explode(F.array_distinct("lines")).alias("line")).select("rid", "host", "line", digest.alias("key"))
    on_pages = lines.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = pages.where("host is not null").groupBy("host").agg(F.count("*").alias("total"))
    boilerplate = cut_lineage(on_pages.join(totals, "host").where(F.col("pages") > F.col("total") * ratio).select("host", "key"))
    dropped = lines.join(boilerplate, ["host", "key"]).groupBy("rid").agg(F.collect_set("line").alias("drop"))  # lines of one page
    out = pages.join(dropped, "rid", "left").withColumn(
        "left", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
            F.filter("lines", lambda x: ~F.array_contains("drop", x))))
    return out.select(
        "row", "host", F.size("lines").cast("long").alias("n_lines"), F.size("left").cast("long").alias("n_kept"),
        F.array_join("left", "\n").alias("text"))
