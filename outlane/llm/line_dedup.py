"""Line de-duplication by site-relative frequency.

A line of a site is boilerplate if the share of the site's pages that contain
it is above a ratio and at least a few pages do.  Built-in functions only: pages
give the hashes of their distinct lines, a partial aggregate counts them per
site, and each site's few boilerplate lines meet its pages as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlane.llm.common import free_name, written

#: Share of a site's pages above which a line is boilerplate.
RATIO = 0.05
#: Pages that must contain the line at least, so small sites lose nothing.
LEAST_PAGES = 5


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """96 bits of a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.crc32(F.encode(line, "UTF-8")).alias("c"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """(site, bad): the boilerplate lines of each site that has any.

    A page has at most its own number of distinct lines, so a site has at most
    (mean lines per page) / ratio of them whatever its size.  Without ``copies``
    pages of a site with the same text are one page, in the counts of lines and
    of pages alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = docs.select(_key(text).alias("page"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("site"),
                        F.array_distinct(F.transform(F.filter(_lines(text_col), lambda x: F.trim(x) != ""), _key)).alias("keys"))
    if not copies:
        pages = pages.groupBy("site", "page").agg(F.first("keys").alias("keys"))
    # one scan counts both: the empty key stands for the page itself
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("c")))
    counts = written(pages.select("site", F.explode(F.concat(own, "keys")).alias("key")).groupBy("site", "key.h", "key.c").agg(F.count("*").alias("n"))
                     .filter((F.col("n") >= least) | F.col("h").isNull()))
    sites = counts.filter("h IS NULL").select("site", F.col("n").alias("pages"))
    return (counts.filter("h IS NOT NULL").join(sites, "site").filter(F.col("n") > ratio * F.col("pages"))
            .groupBy("site").agg(F.collect_set(F.struct("h", "c")).alias("bad")))


def site_line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text.

    Lines end at ``\\n``; lines of white space are never boilerplate; a line
    repeated on one page counts one time, and every copy of it goes.  All rows
    stay, also those left with an empty text.  A null text stays null.  Null
    sites form one site, the same as the empty name.  The other columns are
    unchanged, whatever their names; two columns are added (or
    replaced): ``lines_before`` and ``lines_dropped`` (a null text has one
    empty line).  Repeated ids are
    separate pages; an empty table gives no rows.  Copies of a text count as
    separate pages of the site, or as one page if ``copies`` is False: then
    copying a page does not turn its lines into boilerplate.
    """
    added = ("lines_before", "lines_dropped")
    names = [c for c in docs.columns if c not in added]
    site_, bad_, kept_ = (free_name(docs, x) for x in ("site_of_lines", "bad_lines", "kept_lines"))
    bad = written(boilerplate(docs, host_col, text_col, ratio, least, copies)).select(F.col("site").alias(site_), F.col("bad").alias(bad_))
    joined = docs.join(bad, F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(site_), "left")
    clean = F.filter(_lines(text_col), lambda x: ~F.array_contains(bad_, _key(x)))
    kept = F.when(F.col(bad_).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept_, "\n"))
    return (joined.withColumn(kept_, F.when(F.col(bad_).isNotNull(), clean))
            .select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
                    F.size(_lines(text_col)).cast("bigint").alias("lines_before"),
                    F.when(F.col(bad_).isNull(), F.lit(0)).otherwise(F.size(_lines(text_col)) - F.size(kept_)).cast("bigint").alias("lines_dropped")))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
pages AS (SELECT site, count(*) AS pages FROM d GROUP BY 1),
has AS (SELECT site, line, count(*) AS n FROM (SELECT site, unnest(list_distinct(lines)) AS line FROM d) WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT site, list(line) AS bad FROM has JOIN pages USING (site) WHERE n >= {LEAST_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages GROUP BY 1),
kept AS (SELECT doc_id, text, lines, bad, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS k
         FROM d LEFT JOIN bad USING (site))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS lines_before, CAST(len(lines) - len(k) AS BIGINT) AS lines_dropped,
       CAST(length(array_to_string(k, chr(10))) AS BIGINT) AS kept_chars, sha256(array_to_string(k, chr(10))) AS kept_sha256
FROM kept"""
