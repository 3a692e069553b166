"""Line dedup by site-relative frequency.

A page's lines are its visible text cut at block tags and newlines, trimmed. For each host and line the share of the
host's pages that contain the line is computed; lines whose share exceeds `ratio` are boilerplate and are dropped. So a
host of one page loses all its lines; `least_pages`, 1 by default, spares hosts of fewer pages.

A page counts once for a line however often it repeats it. (host, line) counts combine on the map side, so a line that
stands on every page of a hot host arrives as one row per map task. A host's boilerplate lines are few: each is on more
than `ratio` of its pages, so there are at most mean-lines-per-page / ratio of them. Pages meet their host's list in a
join salted by `salts`: the list is repeated for each salt, so a hot host's pages spread over that many tasks.

Nulls: a null page body has no lines, a null or unparsable address is the host ''. A line on exactly `ratio` of the pages
stays. Repeated page rows count as pages of their own. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read

RATIO, LEAST_PAGES, SALTS = 0.5, 1, 32

#: HTML elements whose content isn't text (what isn't closed hides the rest of the page), and elements that
#: end a line. No pattern reads on from one start over the next, so a page takes linear time whatever it leaves open.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>"
TAG = r"<[^<>]*>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The lines of a page, in order, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(lines, lambda x: x != "")


def split_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, lines."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, pages, lines: the lines on more than `ratio` of the host's pages. pages: as split_lines gives them."""
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    seen = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = seen.join(total, "host").filter(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("host").agg(F.max("pages").alias("host_pages"), F.sort_array(F.collect_list("line")).alias("drop"))


def line_dedup(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, salts: int = SALTS) -> DataFrame:
    """One row for each row of pages: page_id, host, n_lines, n_dropped, text (the lines that stay, newline-joined)."""
    split = Scratch(pages.sparkSession).table(split_lines(pages))  # read for the counts and for the pages
    table = boilerplate(split, ratio, least_pages).select("host", "drop", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = split.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(salts)).cast("int"))
    out = rows.join(table, ["host", "salt"], "left")
    stay = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", x)))
    out = out.withColumn("stay", stay)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup(read(spark, sf_dir, "pages"))


OP6_SQL = f"""
WITH split AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '{HIDDEN}', ' ', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
           lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
total AS (SELECT host, count(*) AS pages FROM split GROUP BY host HAVING count(*) >= {LEAST_PAGES}),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split) GROUP BY host, line),
often AS (SELECT host, list(line) AS dropped FROM seen JOIN total USING (host) WHERE n > pages * {RATIO} GROUP BY host),
done AS (SELECT page_id, host, lines, CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, x)) END AS stay
         FROM split LEFT JOIN often USING (host))
SELECT CAST(page_id AS BIGINT) AS page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS text
FROM done
"""
