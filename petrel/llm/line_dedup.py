"""Line dedup by site-relative frequency. DataFrame functions only.

For each host the pages that hold a line are counted and divided by the host's pages; a line whose share exceeds the
boilerplate ratio (and that enough pages of the host hold) is dropped from every page of the host. Lines are compared
after trimming white space; block-level markup ends a line, as a line feed does.

Only 128-bit line hashes are shuffled, once per page and line and summed before the shuffle. What is dropped of a host
is bounded: lines on more than ``ratio`` of its pages are at most (lines a page) / ratio, so they come back to the
pages as one list a host. Pages of a large host are not gathered: each host's list is there ``SALTS`` times, and a page meets one of them by its hash.

Defined results: null html has no lines and an empty result text; a null or hostless url belongs to the host "" and
counts like any other; empty lines are neither counted nor kept; a line repeated in a page counts once but is dropped everywhere in it;
pages that share an id count as pages each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: A line on more than this share of a host's pages, and on at least so many of them, is boilerplate.
RATIO, LEAST_PAGES = 0.3, 3
#: Tasks that the pages of a host are dealt to at least, where pages are shuffled at all.
SALTS = 16
#: Ends a line: a line feed, or a tag of a block (the tag itself is no part of a line).
BREAK = r"\n|</?(?:p|div|nav|ul|ol|li|footer|header|article|section|aside|main|h[1-6]|br|tr|td|th|table|title|head|body|html|script|style|form|option|select)(?:[ \t\n/][^<>]*)?>"
_SPACE = " \t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and a leading "www."."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))), r"^www\.", "")


def lines_of(html: Column) -> Column:
    """The lines of a page, trimmed, without empty ones."""
    cut = F.split(F.coalesce(html, F.lit("")), BREAK)
    return F.filter(F.transform(cut, lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: x != "")


def boilerplate(lined: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, dropped): the hashes of the lines to drop of each host that has any. ``lined``: (host, hashes) a page."""
    totals = lined.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = lined.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    over = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("dropped"))


def dedup(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, text (the lines left, joined by line feeds)."""
    p = pick(pages, page_id="long", url="string", html="string")
    lined = p.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    drop = boilerplate(lined.select("host", hashed.alias("hashes")), ratio, least_pages)
    drop = drop.select(F.col("host").alias("of"), "dropped", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salt = F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(SALTS)).cast("int")
    both = lined.join(drop, (F.col("host") == F.col("of")) & (salt == F.col("part")), "left")
    keep = F.filter("lines", lambda x: ~F.array_contains("dropped", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    left = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(keep)
    out = both.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), left.alias("left"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("text"))


def digest(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    d = dedup(pages, ratio, least_pages)
    return d.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERY_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
         regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')), '^www\.', '') AS host,
         list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{break}'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
e AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM e GROUP BY host, line),
b AS (SELECT c.host, c.line FROM c JOIN t ON c.host = t.host WHERE n >= {least} AND n > {ratio}::DOUBLE * pages),
u AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
k AS (
  SELECT u.r, count(*) FILTER (b.line IS NOT NULL) AS n_dropped, string_agg(u.line, chr(10) ORDER BY u.pos) FILTER (b.line IS NULL) AS kept
  FROM u LEFT JOIN b ON u.host = b.host AND u.line = b.line GROUP BY u.r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN k ON p.r = k.r
""".replace("{break}", BREAK.replace("'", "''")).replace("{least}", str(LEAST_PAGES)).replace("{ratio}", str(RATIO))
