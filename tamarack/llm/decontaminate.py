"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import Scratch, keys_for_join, row_key

#: Fixed masks over consecutive tokens: 1 is hashed, 0 may differ. Each starts and ends with 1.
MASKS = ("110110010111", "101100111011", "111011101101")
SPAN = len(MASKS[0])
#: Around a hit, so many tokens of the item and of the document are compared on each side of the mask.
MARGIN = 4
#: Contaminated from this share of equal tokens, over at least so many tokens (or the whole item, if shorter).
LEAST_SHARE = 0.8
LEAST_OVERLAP = 13
#: Benchmarks of up to so many hashed windows are sent to every task; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

SEPARATOR = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _windows(df: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """``keep``, ``at``, ``span`` and ``hash`` for each mask and position of ``words``.

    Hashes are made within the array, and only they are exploded: rows with the words in them
    would be copied once a position. The outer explode keeps the optimizer from asking for the
    array's size first, which would make it twice; the null row of an empty array joins nothing.
    """
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    def under(mask: str) -> Column:
        last = F.size("hashes") - len(mask)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(len(mask)).alias("span"), F.xxhash64(F.lit(mask), *[F.get("hashes", i + k) for k, c in enumerate(mask) if c == "1"]).alias("hash")))

    made = hashed.select(*keep, F.concat(*[under(m) for m in masks]).alias("windows"))
    return made.select(*keep, F.explode_outer("windows").alias("w")).select(*keep, "w.at", "w.span", "w.hash")


def _equal(doc: Column, item: Column) -> Column:
    """How many places of two arrays of one length hold the same token."""
    return F.size(F.filter(F.zip_with(doc, item, lambda a, b: a == b), lambda same: same)).cast("long")


def _around(words: str, at: str) -> tuple[Column, Column, Column]:
    """Up to MARGIN tokens before a hit, those under it, and up to MARGIN behind it."""
    before = F.least(F.lit(MARGIN), F.col(at))
    behind = F.col(at) + F.col("span")
    return F.slice(words, F.col(at) - before + 1, before), F.slice(words, F.col(at) + 1, F.col("span")), F.slice(words, behind + 1, F.lit(MARGIN))


def _verified(windows: DataFrame) -> DataFrame:
    """Hits with the tokens around them on both sides (doc_before, doc_under, doc_behind, item_before, ..., item_size); adds ``best``.

    Of all stretches that hold the hit and up to MARGIN tokens before and behind it, the one with the most
    equal tokens counts that is long and equal enough.
    """
    left = F.least(F.size("doc_before"), F.size("item_before"))
    right = F.least(F.size("doc_behind"), F.size("item_behind"))
    end = lambda words, n: F.slice(words, F.size(words) - n + 1, n)
    sized = windows.withColumn("under", _equal(F.col("doc_under"), F.col("item_under"))).withColumn("left", left).withColumn("right", right)
    same = sized.withColumn("left_same", F.reverse(F.zip_with(end("doc_before", F.col("left")), end("item_before", F.col("left")), lambda a, b: (a == b).cast("int"))))
    same = same.withColumn("right_same", F.zip_with(F.slice("doc_behind", F.lit(1), F.col("right")), F.slice("item_behind", F.lit(1), F.col("right")), lambda a, b: (a == b).cast("int")))
    first = lambda flags, n: sum((F.coalesce(F.get(flags, F.lit(k)), F.lit(0)) for k in range(n)), F.lit(0))
    tried = []
    for a in range(MARGIN + 1):
        for b in range(MARGIN + 1):
            overlap, matched = F.col("span") + a + b, F.col("under") + first("left_same", a) + first("right_same", b)
            enough = (F.col("left") >= a) & (F.col("right") >= b) & (overlap >= F.least(F.lit(LEAST_OVERLAP), F.col("item_size"))) & (matched >= LEAST_SHARE * overlap)
            tried.append(F.when(enough, F.struct(matched.cast("long").alias("matched"), overlap.cast("long").alias("overlap"))))
    return same.withColumn("best", F.array_max(F.array(*tried))).where("best IS NOT NULL")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per pair of a document and a benchmark item that it contains: row, id, item, matched, overlap.

    ``row`` is :func:`~tamarack.llm.common.row_key` of id and text. Both sides are lower-case
    runs of letters and digits. Every window of SPAN tokens of every document is hashed under
    each mask, with the tokens at the mask's zeros left out, and joined to the benchmark's;
    around each hit, up to MARGIN tokens more on each side are compared place by place, and the
    best stretch that holds the hit counts. A pair is reported with its largest number of
    ``matched`` tokens of ``overlap``. Items shorter than the masks must occur whole.

    Null and empty texts and items contain nothing and are contained in nothing. Repeated rows
    give one pair, and of equally many matched tokens the longer stretch counts; every position of a
    very long text is hashed; rows of a null id are reported with a null id; an empty table gives no row;
    other columns are not read. A small benchmark (by its counted windows) is broadcast, so
    that the documents' hashes are not shuffled; a larger one is joined by a shuffle of hashes.
    Only the documents with hits are read again, to be compared.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = source.select(row_key(F.col("id"), F.col("text")).alias("row"), "id", "text")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct()
    items = scratch.cut(items.withColumn("item_key", F.xxhash64(F.to_json(F.struct("item")), "words")), "items")
    short = sorted(r.n for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())  # SPAN - 1 numbers at most
    wanted = _windows(items.where(F.size("words") >= SPAN), ["item_key"], list(MASKS))
    for n in short:
        wanted = wanted.union(_windows(items.where(F.size("words") == n), ["item_key"], ["1" * n]))
    wanted = scratch.cut(wanted.select("item_key", F.col("at").alias("item_at"), "span", "hash").where("hash IS NOT NULL"), "windows")
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)  # of checked size: rows of four numbers
    placed = _windows(keyed.select("row", words_of(F.col("text")).alias("words")), ["row"], [*MASKS, *["1" * n for n in short]])
    hits = scratch.cut(placed.join(wanted, ["hash", "span"]).select("row", "at", "span", "item_key", "item_at").distinct(), "hits")
    rows = scratch.cut(hits.select("row").distinct(), "rows")
    met = keyed.join(keys_for_join(rows), "row", "left_semi").distinct().select("row", "id", words_of(F.col("text")).alias("words"))
    windows = hits.join(met, "row").select("row", "id", "span", "item_key", "item_at", *[c.alias(f"doc_{n}") for n, c in zip(("before", "under", "behind"), _around("words", "at"), strict=True)])
    windows = windows.join(items, "item_key").select("row", "id", "span", "item_key", "item", "doc_before", "doc_under", "doc_behind", F.size("words").alias("item_size"), *[c.alias(f"item_{n}") for n, c in zip(("before", "under", "behind"), _around("words", "item_at"), strict=True)])
    best = _verified(windows).groupBy("row", "id", "item_key", "item").agg(F.max("best").alias("best"))
    return best.select("row", "id", "item", "best.matched", "best.overlap")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; null ids and texts stay."""
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **columns)
    rows = Scratch(docs.sparkSession, "decontaminate").cut(found.select(F.col("row").alias("\x01row")).distinct(), "rows")
    return docs.withColumn("\x01row", row_key(F.col(id_col), F.col(text_col))).join(keys_for_join(rows), "\x01row", "left_anti").select(*docs.columns)
