"""Site-relative line dedup, in DataFrame functions alone.

For each host the share of its pages that hold a line is the number of pages with that line over the number of the
host's pages; lines above a ratio are boilerplate of that host and are dropped from its pages.

A line is known by a 64-bit hash of its trimmed text. Counts are combined before the shuffle, so neither a hot host nor
a line on every page gathers rows in a task. A host has at most (its lines per page / ratio) boilerplate lines, so the
list of a host is short; the lists of all hosts go to every task only if they have at most BROADCAST_LINES lines
together, and otherwise meet the pages by (host, salt), each list SALTS times, each host's pages over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: 8 bytes each: at most a few MB of lists go to every task.
BROADCAST_LINES = 200_000
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if it has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """Hash of a line without blanks at its ends."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, key: lines on more than ratio of the host's pages, and on min_pages at least. pages has host and text.

    A blank line is never boilerplate; a line that a page repeats counts once for it.
    """
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r")) != ""), key_of))
    # A null key on each page counts the pages in the same pass.
    every = F.concat(keys, F.array(F.lit(None).cast("long")))
    counted = materialize(pages.select("host", F.explode(every).alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages")).where((F.col("pages") >= min_pages) | F.col("key").isNull()), "line-counts")
    total = counted.where("key is null").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    on = counted.where("key is not null").join(total, F.col("host") == F.col("of"))
    return on.where(F.col("pages") > F.col("total") * ratio).select("host", "key")


def line_dedup(docs: DataFrame, host: Column, ratio: float = 0.1, min_pages: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, text, lines, dropped, and the columns carry: each page without its host's boilerplate lines.

    Rows of a null host form a site of their own (the empty host). A null text stays null and has one, empty, line;
    a text all of whose lines go is empty. Repeated rows are pages each. Kept lines stay as they are, in their order.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"), *carry)
    found = materialize(boilerplate(source.select("host", "text"), ratio, min_pages), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_set("key").alias("keys")).withColumnRenamed("host", "of")
    if found.count() <= BROADCAST_LINES:
        joined = source.join(F.broadcast(lists), F.col("host") == F.col("of"), "left")
    else:
        lists = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = source.withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        joined = salted.join(lists, (F.col("host") == F.col("of")) & (F.col("at") == F.col("salt")), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("keys"), key_of(x))))
    out = joined.withColumn("kept", kept)
    return out.select(
        "doc_id", "host", F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"), F.size(lines).cast("long").alias("lines"),
        (F.size(lines) - F.size("kept")).cast("long").alias("dropped"), *carry,
    )


#: The same for documents by source, for DuckDB.
SQL = """
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
on_page AS (SELECT DISTINCT doc_id, host, trim(u.line, ' ' || chr(9) || chr(13)) AS line FROM pages, unnest(all_lines) AS u(line)),
counted AS (SELECT host, line, count(*) AS pages FROM on_page WHERE line <> '' GROUP BY host, line HAVING count(*) >= {min_pages}),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
bad AS (SELECT c.host, list(c.line) AS lines FROM counted c JOIN totals t ON c.host = t.host WHERE c.pages > t.total * {ratio} GROUP BY c.host),
kept AS (
  SELECT p.doc_id, p.host, p.text, p.all_lines,
         list_filter(p.all_lines, lambda x: NOT list_contains(coalesce(b.lines, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept_lines
  FROM pages p LEFT JOIN bad b ON p.host = b.host
)
SELECT doc_id, host, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept_lines, chr(10)) END AS text,
       CAST(len(all_lines) AS BIGINT) AS lines, CAST(len(all_lines) - len(kept_lines) AS BIGINT) AS dropped
FROM kept
"""
