"""Line dedup (5): lines on a large share of a host's pages are boilerplate and are dropped.

Built-in functions only. A line is compared without blanks at its ends; blank
lines are neither counted nor dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is boilerplate on more than this share of a host's pages.
RATIO = 0.03
#: Pages that make a line a repeated one: the only line of a host with one page is on all of them.
REPEATED = 2


def _key(line: Column) -> Column:
    """128 bits that stand for a line; null for a blank one."""
    return F.when(F.trim(line) != "", F.unhex(F.md5(F.trim(line).cast("binary"))))


def boilerplate_lines(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO) -> DataFrame:
    """(``host``, ``line``, ``pages``, ``ratio``) of the lines to drop; ``line`` is the line's key.

    Each page counts a line once, whatever its repeats, and counts are combined
    before they are shuffled, so neither a hot host nor a hot line meets in one task.
    """
    host = F.col(host_col).alias("host")
    lines = pages.select(host, F.explode(F.array_distinct(F.transform(F.split(text_col, "\n"), _key))).alias("line"))
    counts = lines.where(F.col("line").isNotNull()).groupBy("host", "line").agg(F.count("*").alias("pages"))
    totals = pages.groupBy(host).agg(F.count("*").alias("host_pages"))
    common = counts.where(F.col("pages") >= REPEATED)
    return common.join(totals, common["host"].eqNullSafe(totals["host"])).select(
        common["host"], "line", "pages", (F.col("pages") / F.col("host_pages")).alias("ratio"),
    ).where(F.col("ratio") > F.lit(ratio))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                     ratio: float = RATIO) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and ``n_lines``, ``n_dropped`` at the end.

    A host's pages are its rows, and the ratio alone decides which repeated
    lines go, on small hosts as on large ones; a host of one page loses none.
    A null host is a host, a null text a page without lines that stays null. All lines dropped leaves an empty text; the
    row stays. Repeated rows are separate pages, and rows with one id share the
    union of their drops. Rows with a null id keep their lines. An empty table
    gives no rows; columns called ``n_lines`` or ``n_dropped`` are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lost = boilerplate_lines(docs, host_col, text_col, ratio).select("host", "line")
    split = F.split(text_col, "\n")
    seen = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(host_col).alias("_host"),
        F.explode(F.array_distinct(F.transform(split, _key))).alias("_line"))
    # The line leads the join: hosts are few and hot, lines of one host are many.
    hits = seen.where(F.col("_line").isNotNull()).join(
        lost, (F.col("_line") == F.col("line")) & F.col("_host").eqNullSafe(F.col("host")))
    drops = hits.groupBy("_id").agg(F.collect_set("_line").alias("_drops"))
    rows = docs.join(drops, docs[id_col] == drops["_id"], "left")
    kept = F.when(F.col("_drops").isNotNull(), F.filter(
        split, lambda x: ~F.coalesce(F.array_contains("_drops", _key(x)), F.lit(False))))
    rows = rows.withColumn("_kept", kept).withColumn("_n", F.coalesce(F.size(split), F.lit(0)).cast("long"))
    text = F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n"))
    out = [F.col(c) if c != text_col else text.alias(c) for c in docs.columns]
    return rows.select(*out, F.col("_n").alias("n_lines"), F.coalesce(F.col("_n") - F.size("_kept"), F.lit(0)).alias("n_dropped"))


def oracle(ratio: float = RATIO) -> str:
    """The same rows in SQL, for ``documents`` with ``source`` as host."""
    return f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), counts AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL
), totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY ALL
), lost AS (
  SELECT counts.source, line FROM counts JOIN totals ON counts.source IS NOT DISTINCT FROM totals.source
  WHERE pages >= {REPEATED} AND pages::DOUBLE / host_pages > {ratio}
), marked AS (
  SELECT lines.*, EXISTS (SELECT 1 FROM lost WHERE lost.source IS NOT DISTINCT FROM lines.source
                          AND lost.line = trim(lines.line, ' ')) AS gone
  FROM lines
), kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, kept.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept USING (doc_id)
"""
