"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm import tokens
from tamarack.llm.common import Scratch, map_arrow, strings

#: Lengths are summed in runs of so many neighbours, and the runs' sums over all runs.
RUN = 4096


def lengths(docs: DataFrame, *, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row ``tokens`` per document: how many ids its whole text has; null and empty texts have 0."""
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens.encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(ids.count, strings(batch.column(0)))), pa.int64())], names=["tokens"])

    return map_arrow(docs.select(F.col(text_col).cast("string")), run, "tokens long")


def histogram(docs: DataFrame, **options) -> DataFrame:
    """``tokens``, ``docs``: how many documents have each encoded length; summed in each task before the shuffle."""
    return lengths(docs, **options).groupBy("tokens").agg(F.count("*").alias("docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds, per length: documents and tokens at this length or above, and below it.

    Sums run in two levels, within runs of RUN lengths and over the runs, so that no task
    sorts the whole histogram; a run's sums are one row.
    """
    run = (F.col("tokens") / RUN).cast("long")
    hist = hist.withColumn("run", run)
    runs = hist.groupBy("run").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("tokens")).alias("t"))
    after = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    runs = runs.select("run", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(total).alias("all_docs"), F.sum("t").over(total).alias("all_tokens"))
    inside = Window.partitionBy("run").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.join(runs, "run").select(
        "tokens",
        "docs",
        (F.sum("docs").over(inside) + F.col("d_after")).alias("docs_from"),
        (F.sum(F.col("docs") * F.col("tokens")).over(inside) + F.col("t_after")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )


def every_limit(docs: DataFrame, **options) -> DataFrame:
    """Answers for every context limit, one row per encoded length that occurs.

    ``context_limit`` is the length; ``docs_at`` documents have exactly it, ``docs_over``
    more; ``all_docs`` and ``all_tokens`` are totals; ``truncated_total`` is the sum over all
    documents of the smaller of length and limit; ``quantile`` is the share of documents of
    at most that length, so the first row whose quantile reaches q holds the q-quantile.
    Between two rows the truncated total is linear, with slope ``docs_over`` of the lower.

    Null and empty texts count with length 0, a very long text is encoded as a whole, repeated
    rows count each, an empty table gives no row, other columns are not read. The runs' sums, one row
    for RUN lengths, meet in one task.
    """
    at: Column = F.col("tokens")
    over = F.col("docs_from") - F.col("docs")
    # written once: both levels of sums read it, and must not encode the documents twice
    hist = Scratch(docs.sparkSession, "token-counts").cut(histogram(docs, **options), "histogram")
    return with_suffix_sums(hist).select(
        at.alias("context_limit"),
        F.col("docs").alias("docs_at"),
        over.alias("docs_over"),
        "all_docs",
        "all_tokens",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * at).alias("truncated_total"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals at any given limits, from the rows of :func:`every_limit`; repeated limits count once, an empty table gives no row.

    Each row answers the limits from its own length up to the next row's, by bisection in the
    sorted limits, which are part of the plan.
    """
    wanted = sorted({int(x) for x in limits})
    if not wanted:
        return table.select(F.col("context_limit").alias("limit"), "truncated_total").limit(0)
    spans = F.array(*[F.lit(x).cast("long") for x in wanted])
    lower = F.max(F.struct("context_limit", "truncated_total", "docs_over"))
    # a row with the first limit that it is below: of all rows of one such limit, the last counts for it
    first = F.filter(spans, lambda x: x >= F.col("context_limit"))
    reached = table.select("context_limit", "truncated_total", "docs_over", "all_docs", F.get(first, F.lit(0)).alias("limit"))
    best = reached.where("limit IS NOT NULL").groupBy("limit").agg(lower.alias("l"))
    totals = table.agg(F.max("all_docs").alias("n"))
    found = best.groupBy().agg(F.array_sort(F.collect_list(F.struct("limit", "l"))).alias("rows"))  # at most one row a limit
    both = totals.select("n", F.lit(1).alias("one")).join(found.withColumn("one", F.lit(1)), "one").where("n IS NOT NULL")
    each = both.select("n", "rows", F.explode(spans).alias("limit"))
    last = F.element_at(F.filter("rows", lambda r: r["limit"] <= F.col("limit")), -1)
    under = each.select("limit", "n", F.when(F.size(F.filter("rows", lambda r: r["limit"] <= F.col("limit"))) > 0, last["l"]).alias("l"))
    return under.select("limit", F.coalesce(F.col("l.truncated_total") + F.col("l.docs_over") * (F.col("limit") - F.col("l.context_limit")), F.col("n") * F.col("limit")).alias("truncated_total"))
