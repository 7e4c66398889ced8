"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import Scratch, blocks, keys_for_join, map_arrow, row_key, text_key
from tamarack.llm.linking import Tile, link, shared_members, tiled
from tamarack.llm.quality_rules import windows_hash, word_hashes

#: Words of a shingle, and the Jaccard similarity of two documents' shingle sets from which they are linked.
SHINGLE = 5
LEAST_SIMILARITY = 0.8
#: Registers of a signature, in bands of ROWS. A pair that agrees in a share s of its registers (its probability Jaccard similarity) shares a
#: band with probability 1 - (1 - s ** ROWS) ** BANDS: over 0.9999 at 0.8. Where shingles repeat in one text only, s falls below the similarity of
#: the sets that is verified; at 0.64 (half of the shingles 20 times in one of two texts of set similarity 0.8) it is still 0.96.
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: See linking: larger open groups go by an exact join of prefixes in tiles, which asks for few pairs.
SMALL, DEPUTIES = 32, 4
#: Characters of the texts whose signatures are drawn together.
TOGETHER = 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Hashes of the word shingles, in order; of a shorter text, of all its words together; of no words, none."""
    hashes = word_hashes(text)
    return windows_hash(hashes, min(SHINGLE, len(hashes))) if len(hashes) else hashes


def prob_min_hash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Per set of (element hashes, weights): for each register the element that arrives first.

    An element arrives in a Poisson process of the rate of its weight, each time at a register
    drawn at random; element and time are drawn from the element's hash alone, so equal elements
    of equal weight arrive alike in all sets. Two sets agree in a register with the probability
    Jaccard similarity of their weights. An element is given up as soon as its next arrival is
    later than the latest register's (early termination), so the work is about one arrival per
    element and ``registers * log(registers)`` per set.
    """
    n = len(sets)
    element = np.concatenate([e for e, _ in sets]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if n else np.zeros(0)
    base = np.repeat(np.arange(n) * registers, [len(e) for e, _ in sets])
    first, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, state = np.zeros(len(element)), mix(element + _A)
    while len(element):
        state = mix(state + _A)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        at = base + (mix(state ^ _C) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = element[won]
        latest = first.reshape(n, registers).max(1) if n else first
        alive = time < latest[base // registers]
        element, weight, base, time, state = element[alive], weight[alive], base[alive], time[alive], state[alive]
    return winner.reshape(n, registers)


def _signatures(keyed: DataFrame) -> DataFrame:
    """node, size (different shingles) and keys (a hash per band) of each text with a word."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _A)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            del batch
            for a, b in blocks(texts, TOGETHER):
                kept, sets = [], []
                for k in range(a, b):
                    found, count = np.unique(shingles(texts[k]), return_counts=True)
                    if len(found):
                        kept.append(nodes[k])
                        sets.append((found, 1 + np.log(count)))
                won = prob_min_hash(sets)
                keys = np.tile(salt, (len(kept), 1))
                for r in range(ROWS):
                    keys = mix(keys ^ won[:, r::ROWS]) if len(kept) else keys
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([len(x) for x, _ in sets], pa.int32()), _lists(keys.view(np.int64), pa.int64())], names=["node", "size", "keys"])

    return map_arrow(keyed, run, "node binary, size int, keys array<long>")


def _lists(table: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(table).ravel(), kind))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix(own: np.ndarray, leader: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set, as they are ordered, or those that the leader lacks before those that it has.

    Sets of similarity LEAST_SIMILARITY share that part of each, so by one order in both
    their first common shingle is among so many of either.
    """
    if leader is not None:
        had = np.isin(own, leader, assume_unique=True)
        own = np.concatenate([own[~had], own[had]])
    return own[: len(own) - math.ceil(LEAST_SIMILARITY * len(own) - 1e-9) + 1]


class _Verifier:
    """Exact Jaccard similarity of the shingle sets of pairs of candidates, each of which is cut once."""

    def __init__(self, keyed: DataFrame, scratch: Scratch):
        self.keyed, self.scratch = keyed, scratch

    def prepare(self, candidates: DataFrame) -> Callable[[DataFrame], DataFrame]:
        texts = self.keyed.join(keys_for_join(candidates), "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingles(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

        self.sets = self.scratch.cut(map_arrow(texts, cut, "node binary, shingles binary"), "shingles")
        return self.verify

    def verify(self, pairs: DataFrame) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = []
                for p, q in zip(batch.column(2), batch.column(3), strict=True):  # one pair at a time
                    x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    hit.append(min(len(x), len(y)) >= LEAST_SIMILARITY * max(len(x), len(y)) and jaccard(x, y) >= LEAST_SIMILARITY)
                yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

        one, two = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), compare, "a binary, b binary")

    def beyond(self, large: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All links between different roots of open large groups, by an exact prefix-filter join in tiles; groups of one leader are one."""
        stars = large.select(F.xxhash64("leader").alias("key"), "node", "size", "bits", "root").distinct()
        return tiled(stars, self.sets.withColumnRenamed("shingles", "value"), _linked, self.scratch)


def _linked(tile: Tile, values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs of a tile of LEAST_SIMILARITY or more that join roots.

    Only sets whose prefixes meet are compared, the rarest shingles of the tile first in all of
    them, and not those whose first common one stands so late that too few can follow.
    """
    size = tile.size.astype(np.int64)
    which, found, times = np.unique(np.frombuffer(b"".join(values), np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(which), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(which))
    ends = np.cumsum(size)
    sets = [np.sort(x) for x in np.split(rank[found], ends[:-1])]
    firsts = [prefix(x) for x in sets]
    member = np.repeat(np.arange(len(sets)), list(map(len, firsts)))
    token, place = np.concatenate(firsts), np.concatenate([np.arange(len(x)) for x in firsts])
    order = np.argsort(token, kind="stable")
    token, member, place = token[order], member[order], place[order]
    start, stop = (np.searchsorted(token, np.arange(len(which)), side=s) for s in ("left", "right"))
    held = np.zeros(len(which), bool)
    for x in tile.asking.tolist():
        at = np.concatenate([np.arange(start[t], stop[t]) for t in firsts[x]])
        own = np.repeat(np.arange(len(firsts[x])), stop[firsts[x]] - start[firsts[x]])
        y, follow = member[at], np.minimum(size[x] - own, size[member[at]] - place[at])
        y = tile.open(x, np.unique(y[follow * (1 + LEAST_SIMILARITY) + 1e-6 >= LEAST_SIMILARITY * (size[x] + size[y])]))
        held[sets[x]] = True
        for k in y.tolist():
            if tile.root[k] != tile.root[x]:
                both = int(held[sets[k]].sum())
                if both / (len(sets[x]) + len(sets[k]) - both) >= LEAST_SIMILARITY:
                    tile.join(x, k)
                    yield x, k
        held[sets[x]] = False


def _has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _classes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (row, node, id, has words) of all documents, and node -> class (id, row kept, documents)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = source.where(_has_words(F.col("text"))).select(text_key(F.col("text")).alias("node"), "text")
    signed = scratch.cut(_signatures(keyed), "signatures")
    members = shared_members(signed, scratch)
    scratch.drop(signed)
    verifier = _Verifier(keyed, scratch)
    fits = F.least("size_a", "size_b") + F.lit(1e-6) >= F.lit(LEAST_SIMILARITY) * F.greatest("size_a", "size_b")
    roots = link(members, verifier.prepare, scratch, fits=fits, beyond=verifier.beyond, small=SMALL, deputies=DEPUTIES)
    rows = source.select(row_key(F.col("id"), F.col("text")).alias("row"), text_key(F.col("text")).alias("node"), "id", _has_words(F.col("text")).alias("worded"))
    rows = scratch.cut(rows, "rows")
    copies = rows.where("worded").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("least"), F.count("*").alias("docs"))
    rooted = scratch.cut(copies.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "docs"), "rooted")
    classes = rooted.groupBy("root").agg(F.min("least").alias("least"), F.sum("docs").alias("docs"))
    return rows, rooted.select("node", "root").join(classes, "root").select("node", F.col("least.id").alias("class_id"), F.col("least.row").alias("kept_row"), F.col("docs").alias("class_docs"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class) and class_docs (how many documents it has).

    Equal texts are one node; nodes are linked when their sets of SHINGLE-word shingles have a
    Jaccard similarity of LEAST_SIMILARITY or more, computed exactly for every pair that the
    signatures propose; classes are connected components. Copies are not expanded into pairs.

    Null, empty and blank texts stand alone, in a class of their own id. A class of null ids only
    has a null class_id. Repeated rows are in one class, and each gives a row. An empty table
    gives no row; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows, classes = _classes(docs, id_col, text_col, scratch)
    found = rows.where("worded").join(classes, "node").select("id", "class_id", "class_docs")
    return found.union(rows.where("NOT worded").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_docs")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id. Documents without words all stay."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows, classes = _classes(docs, id_col, text_col, scratch)
    dropped = rows.where("worded").join(classes, "node").where("row != kept_row").select(F.col("row").alias("\x01row")).distinct()
    dropped = scratch.cut(dropped, "dropped")
    keyed = docs.withColumn("\x01row", row_key(F.col(id_col), F.col(text_col)))
    kept = keyed.join(keys_for_join(dropped), "\x01row", "left_anti")
    if not rows.where("worded").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # whole rows that repeat: only then the texts are grouped
        worded = _has_words(F.col(text_col))
        kept = kept.where(worded).dropDuplicates(["\x01row"]).union(kept.where(~worded))
    return kept.select(*docs.columns)
