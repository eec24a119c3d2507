"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines above a ratio are the host's
boilerplate and go. A page counts once however often it holds the line, and copies of one text under several ids are
one page, so a host that serves a page many times doesn't make that page's own lines boilerplate.

Everything is DataFrame work: lines travel as hashes, counts are combined before they are shuffled and are keyed by
(host, line, page), so neither a large host nor a frequent line meets in one task. A host's boilerplate is bounded by
its mean lines per page over the ratio, and joins as one array per host. It is written first, so Spark knows its size
and broadcasts it only if it is small; else texts are shuffled, and large hosts split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import free, stored

#: Share of a host's pages above which a line is boilerplate. A line on one page only repeats nothing and stays anyhow.
RATIO = 0.1


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(rows: DataFrame, ratio: float) -> DataFrame:
    """_host, _lines (hashes of its boilerplate) from rows of _host, _text."""
    keyed = rows.filter(F.col("_host").isNotNull() & F.col("_text").isNotNull()).select("_host", F.xxhash64("_text").alias("_page"), "_text")
    totals = keyed.groupBy("_host").agg(F.count_distinct("_page").alias("_pages"))
    one = F.explode(F.array_distinct(F.transform(F.filter(lines(F.col("_text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x)))))
    counts = keyed.select("_host", "_page", one.alias("_line")).groupBy("_host", "_line").agg(F.count_distinct("_page").alias("_n"))
    return counts.filter("_n > 1").join(totals, "_host").filter(F.col("_n") > ratio * F.col("_pages")).groupBy("_host").agg(F.collect_list("_line").alias("_lines"))


def counts_name(docs: DataFrame) -> str:
    """The name of the column that drop_lines() adds: _dedup, with underscores behind it if docs has that already."""
    return free("_dedup", docs.columns)


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines and n_dropped (long) of each text in counts_name().

    Lines are compared without spaces around them and dropped whole; blank lines stay. A null text stays null (no
    lines); a null host has no boilerplate. Texts that lose nothing come out as they were, whole whatever their length; a
    line just at the ratio stays. Repeated rows stay, and count as one page; an empty table stays empty. All columns are
    kept, whatever their names.
    """
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    found = boilerplate(docs.select(host.alias("_host"), text.alias("_text")), ratio).withColumnRenamed("_host", "_boiler_host")
    found = stored(found, "boilerplate")  # its size is known before it is joined: texts needn't be shuffled if it is small
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).join(found, F.col(f"_row.`{host_col}`").cast("string") == F.col("_boiler_host"), "left")
    old = F.col(f"_row.`{text_col}`")
    # The intersection hashes the host's lines once a text; what is left to look through is the text's own boilerplate.
    mine = F.array_intersect(F.transform(lines(old), lambda x: F.xxhash64(F.trim(x))), F.col("_lines"))
    shaped = joined.select("_row", mine.alias("_mine"))
    kept = F.when(F.size("_mine") > 0, F.filter(lines(old), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_mine"), F.xxhash64(F.trim(x)))))
    shaped = shaped.select("_row", kept.alias("_kept"))
    n = F.coalesce(F.size(lines(old)), F.lit(0)).cast("long")
    lost = F.when(F.col("_kept").isNull() | old.isNull(), F.lit(0)).otherwise(F.size(lines(old)) - F.size("_kept")).cast("long")
    new = F.when(lost > 0, F.array_join("_kept", "\n")).otherwise(old)
    columns = [new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return shaped.select(*columns, F.struct(F.when(old.isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_lines"), lost.alias("n_dropped")).alias(counts_name(docs)))


def cleaned(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """docs without boilerplate lines, with docs' own columns, whatever their names.

    As drop_lines(): null texts and hosts, empty and long texts, repeated rows and empty tables come out as they say there.
    """
    return drop_lines(docs, host_col, text_col, ratio).drop(counts_name(docs))


#: DuckDB: the same over raw lines.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, source, text, u.line, u.i FROM d, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u),
t AS (SELECT source, count(DISTINCT text) AS pages FROM d WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
b AS (SELECT l.source, trim(line) AS line FROM l JOIN t USING (source) WHERE trim(line) <> '' GROUP BY l.source, trim(line), t.pages
      HAVING count(DISTINCT text) > 1 AND count(DISTINCT text) > {RATIO} * t.pages),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped, string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL) AS kept
      FROM l LEFT JOIN b ON l.source = b.source AND trim(l.line) = b.line GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN coalesce(n_dropped, 0) = 0 THEN text ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN k USING (r)
"""
