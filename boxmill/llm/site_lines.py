"""Line dedup by site-relative frequency.

A line that stands on a large share of a host's pages is boilerplate of that host, however rare it is
elsewhere.  Every line counts once a page; the pages of a line are divided by the pages of its host, and
lines beyond the ratio are taken out of all the host's pages.

Lines travel as 128-bit digests, one small row per page and line, added up before the shuffle.  What comes
back to the pages is one row per host: its boilerplate lines, whose mean number cannot exceed the lines a
page has on average, divided by the ratio.  Hosts with very many pages are spread by ``lookup_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.operators.skew import lookup_join
from boxmill.session import settle

RATIO = 0.1
MIN_PAGES = 5
# fixed values: the ASCII white space that is trimmed off a line before lines are compared
BLANKS = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host of ``pages`` (columns host, text) with boilerplate: host, pages, and the line digests.

    A line is boilerplate when it stands on at least ``min_pages`` pages and on more than ``ratio`` of the
    pages of its host.  The written table has one row per host.
    """
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), _key))
    blank = F.md5(F.lit("").cast("binary"))
    per_line = (
        pages.select("host", F.explode(lines).alias("line"))
        .where(F.col("line") != blank)
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    hosts = settle(pages.groupBy("host").agg(F.count("*").alias("pages")))
    common = lookup_join(per_line, hosts, ["host"], "inner", weight="pages", written=True)
    return settle(
        common.where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host", "pages")
        .agg(F.sort_array(F.collect_list("line")).alias("boilerplate"))
    )


def drop_site_lines(
    docs: DataFrame,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Every row is a page, also one that repeats another.  Lines are cut at ``\\n`` and compared without
    ASCII white space at their ends; lines with nothing else are never boilerplate.  Kept lines stay as
    they are, in order.  Rows of a NULL host are pages of one host of their own; a NULL text has no lines
    and stays NULL.  A page of boilerplate alone gets the empty text.  No row is ever dropped; further
    columns pass through, and one already called n_lines or n_dropped is replaced.
    """
    named = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))
    found = boilerplate(docs.select(named.alias("host"), F.col(text).alias("text")), ratio, min_pages)
    rows = docs.select(named.alias("host"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = lookup_join(rows, found, ["host"], "left", weight="pages", written=True)
    body = F.col("row")[text]
    lines = F.split(body, "\n", -1)
    # only digests that this page has are looked for line by line
    here = F.array_intersect(F.transform(lines, _key), F.col("boilerplate"))
    kept = F.transform(
        F.array(here), lambda gone: F.filter(lines, lambda line: ~F.array_contains(gone, _key(line)))
    )[0]
    clean = F.when(F.size(here) > 0, kept).otherwise(lines)
    out = joined.select("row", F.when(F.col("boilerplate").isNull(), lines).otherwise(clean).alias("kept"), body.alias("body"))
    added = {
        text: F.when(F.col("body").isNotNull(), F.array_join("kept", "\n")),
        "n_lines": F.coalesce(F.size(F.split("body", "\n", -1)), F.lit(0)).cast("long"),
    }
    added["n_dropped"] = (added["n_lines"] - F.coalesce(F.size("kept"), F.lit(0))).cast("long")
    plain = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return out.select(*plain, *[c.alias(name) for name, c in added.items()])


def drop_site_lines_sql(docs: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same rows in DuckDB SQL: doc_id, n_lines, n_dropped and text of the table or view ``docs``."""
    trimmed = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, coalesce('h' || source, 'n') AS host, text FROM {docs}),
lines AS (SELECT page, host, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM pages),
sizes AS (SELECT host, count(*) AS n_pages FROM pages GROUP BY host),
common AS (SELECT host, {trimmed} AS line, count(DISTINCT page) AS n FROM lines
    WHERE {trimmed} <> '' GROUP BY 1, 2),
boiler AS (SELECT host, line FROM common JOIN sizes USING (host) WHERE n >= {min_pages} AND n > {ratio!r}::DOUBLE * n_pages),
kept AS (SELECT l.page, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (b.line IS NULL), '') AS text
    FROM lines l LEFT JOIN boiler b ON b.host = l.host AND b.line = {trimmed.replace('line', 'l.line')} GROUP BY l.page)
SELECT p.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
    CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text
FROM pages p LEFT JOIN kept k USING (page)"""
