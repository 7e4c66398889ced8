"""Links between rows that share a key, without all pairs of a group, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import Scratch, keys_for_join, map_arrow

#: Open groups of up to so many members are compared pair by pair, where they are not joined yet.
SMALL = 256
#: So many members (to twice as many, about) of an open group of more than twice so many are compared with all others.
DEPUTIES = 16
#: Members of a part of an open group, about, and their sizes together; two parts make a tile, which is compared in memory.
PART, PART_SIZE = 1024, 1 << 20


def shared_members(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Written table of key, node, size and bits: each node under each of its keys that another node has too.

    ``nodes`` is a written table of ``node``, ``size``, ``keys`` and perhaps ``bits`` (array<long>, what
    goes with each key); rows of one node may repeat. Whether a key is shared is found from fixed-width numbers, which are
    aggregated before the shuffle.
    """
    marked = nodes.select("keys", F.xxhash64("node").alias("mark")).select(F.explode("keys").alias("key"), "mark")
    shared = marked.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low != high").select("key")
    shared = scratch.cut(shared, "shared")
    bits = F.expr("bits[place]") if "bits" in nodes.columns else F.lit(0).cast("long")  # of shared keys only
    rows = nodes.select("*", F.posexplode("keys").alias("place", "key"))
    members = scratch.cut(rows.join(keys_for_join(shared), "key").select("key", "node", "size", bits.alias("bits")).distinct(), "members")
    scratch.drop(shared)
    return members


def link(members: DataFrame, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], scratch: Scratch, *, fits: Column, beyond: Callable[..., DataFrame], small: int = SMALL, deputies: int = DEPUTIES) -> DataFrame:
    """(node, root) of the nodes that links join: all that share a key and pass verification, directly or by others.

    ``members`` are those of :func:`shared_members`. ``prepare`` gets the nodes that may be compared
    and gives a function from pairs (a, b) to those of them that are links. A pair that does
    not meet ``fits`` (of size_a, bits_a, size_b and bits_b) is no link.

    First every member is compared with one leader of its group, that which shares the most keys
    with others: one pair a member. A group that this joins as a whole is done, as families of
    copies mostly are. In a larger group that stays open, members are compared with some others
    drawn by hash, which joins most of what copies the copies. In a group that is still open,
    members of different components are compared: pair by pair up to ``small`` members, so the
    work is at most ``small`` pairs a member; in larger groups as ``beyond(groups, members, verify)`` says, which gets all members of the open
    large groups (key, node, size, bits, root, leader) and gives all links between different roots, as by :func:`tiled`.
    """
    sizes = scratch.cut(members.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    known = scratch.cut(members.join(keys_for_join(sizes), "key").groupBy("node").agg(F.sum("n").alias("known")), "known")
    best = members.join(keys_for_join(known), "node").groupBy("key").agg(F.max(F.struct("known", "node", "size", "bits")).alias("l"), F.count("*").alias("n"))
    leaders = scratch.cut(best.select("key", F.col("l.node").alias("leader"), F.col("l.size").alias("size_b"), F.col("l.bits").alias("bits_b"), "n"), "leaders")
    led = scratch.cut(members.join(leaders, "key"), "led")
    scratch.drop(sizes, known, leaders)
    star = led.where("node != leader").withColumnsRenamed({"size": "size_a", "bits": "bits_a"}).where(fits)
    star = scratch.cut(star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "stars")
    asked = led.where("n > 2").select("node").union(star.select("a")).union(star.select("b")).distinct()
    verify = prepare(scratch.cut(asked, "candidates"))
    roots = components(scratch.cut(verify(star), "links"), scratch)
    rooted = _rooted(led.where("n > 2"), roots, scratch)
    # by powers of two, so that the groups of one family draw the same ones
    drawn = F.when(F.xxhash64("node").bitwiseAND(F.expr(f"shiftleft(1L, CAST(floor(log2(n / {deputies})) AS int)) - 1L")) == 0, F.struct("node", "size", "bits", "root"))
    chosen = rooted.where(F.col("n") > 2 * deputies).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.collect_set(drawn).alias("d"))  # of each group, up to twice so many, about
    chosen = scratch.cut(chosen.where("low != high").select("key", F.explode("d").alias("d")).select("key", F.col("d.node").alias("deputy"), F.col("d.size").alias("size_b"), F.col("d.bits").alias("bits_b"), F.col("d.root").alias("root_b")), "deputies")
    if not chosen.isEmpty():
        met = rooted.join(keys_for_join(chosen), "key").where("node != leader AND deputy != leader AND root != root_b").withColumnsRenamed({"size": "size_a", "bits": "bits_a"}).where(fits)
        met = met.select(F.least("node", "deputy").alias("a"), F.greatest("node", "deputy").alias("b")).distinct()
        roots = _joined(roots, verify(scratch.cut(met, "deputies-asked")), scratch)
        rooted = _rooted(led.where("n > 2"), roots, scratch)
    mark = F.xxhash64("root")
    opened = rooted.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low != high").select("key")
    opened = rooted.join(keys_for_join(scratch.cut(opened, "open")), "key", "left_semi")
    x, y = (opened.where((F.col("n") <= small) & (F.col("node") != F.col("leader"))).select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "bits", "root")]) for side in "ab")
    pairs = x.join(y, "key").where(F.expr("node_a < node_b AND root_a != root_b") & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    made = scratch.cut(verify(scratch.cut(pairs, "pairs")), "links-small")
    large = scratch.cut(opened.where(F.col("n") > small).drop("n"), "open-large")
    if not large.isEmpty():
        made = made.union(scratch.cut(beyond(large, members, verify), "links-large"))
    scratch.drop(led, star, rooted, large)
    return _joined(roots, made, scratch)


def tiled(large: DataFrame, values: DataFrame, compare: Callable[[Tile, list], Iterator[tuple[int, int]]], scratch: Scratch, *, part: int = PART, part_size: int = PART_SIZE) -> DataFrame:
    """Links (a, b) between different roots of open groups, whatever their size: any two members of a group that may be linked meet in a tile.

    ``large`` has key, node, size, bits and root, ``values`` (node, value) what ``compare`` needs of a
    node. Members of the root that most of a group has are joined already, so they only meet
    the others. Both kinds are dealt to parts by hash, and a part of the others is compared within
    itself, with each other part of them and with each part of the most. A small group is one tile.
    So a group makes as many rows as it has members times parts of the others, and no rows of pairs: ``compare`` gives
    those (places in the tile) that join roots.
    """
    each = large.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("s"))
    groups = each.groupBy("key").agg(F.max(F.struct("n", "s", "root")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    few = (F.col("n") <= part) & (F.col("s") <= part_size)
    parts = lambda n, s: F.least(n, F.greatest(F.ceil(n / part), F.ceil(s / part_size)))
    others = F.when(few, 1).otherwise(parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")))
    groups = groups.select("key", F.col("most.root").alias("most"), others.cast("int").alias("others"), F.when(few, 0).otherwise(parts(F.col("most.n"), F.col("most.s"))).cast("int").alias("mosts"))
    dealt = large.join(keys_for_join(scratch.cut(groups, "parts")), "key").withColumn("main", F.col("root") == F.col("most"))
    at = F.when(F.col("main") & (F.col("mosts") > 0), F.expr("others + pmod(xxhash64(node), mosts)")).otherwise(F.expr("pmod(xxhash64(node), others)")).cast("int")
    tiles = F.expr("transform(sequence(0, CASE WHEN at < others THEN others + mosts ELSE others END - 1), x -> struct(least(at, x) AS i, greatest(at, x) AS j))")
    dealt = dealt.withColumn("at", at).select("key", F.explode(tiles).alias("t"), "at", "main", "node", "size", "bits", "root").join(values, "node")
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, since rows that are few take long
    dealt = dealt.select("key", "t.i", "t.j", "at", "main", "node", "size", "bits", "root", "value").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (_, i, j), members in groupby(rows, key=lambda row: row[:3]):
            _, _, _, side, main, nodes, size, bits, root, values = zip(*members, strict=True)
            number = {r: k for k, r in enumerate(set(root))}
            tile = Tile(np.array(main), np.array([number[r] for r in root]), np.array(size), np.array(bits, np.int64).view(np.uint64), np.array(side) if i < j else None)
            links = list(compare(tile, values))
            yield pa.RecordBatch.from_arrays([pa.array([nodes[pair[k]] for pair in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(dealt, run, "a binary, b binary")


class Tile:
    """Members of an open group that are compared in memory; roots that a link joins are one from then on."""

    def __init__(self, main: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, side: np.ndarray | None):
        self.main, self.root, self.size, self.bits, self.side = main, root, size, bits, side
        self.asking = np.flatnonzero(~main)

    def open(self, x: int, among: np.ndarray | None = None) -> np.ndarray:
        """Members that ``x``, one of ``asking``, is to be compared with, each pair once; perhaps only some of these."""
        y = np.arange(len(self.root)) if among is None else among
        ok = (self.root[y] != self.root[x]) & (self.main[y] | (y > x))
        return y[ok & (self.side[y] != self.side[x])] if self.side is not None else y[ok]

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart till now."""
        old, new = self.root[y], self.root[x]
        if old != new:
            self.root[self.root == old] = new
        return old != new


def _rooted(led: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """The members with the root of the component that each is part of."""
    return scratch.cut(led.join(keys_for_join(roots), "node", "left").select("key", "node", "size", "bits", F.coalesce("root", "node").alias("root"), "leader", "n"), "rooted")


def _joined(roots: DataFrame, made: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) after further links (a, b), of which one between each two components counts."""
    known = keys_for_join(roots)
    ends = made.join(known.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    ends = scratch.cut(ends, "between")
    if ends.isEmpty():
        return roots
    above = components(ends, scratch)
    moved = roots.join(keys_for_join(above.select(F.col("node").alias("root"), F.col("root").alias("far"))), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    alone = above.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return scratch.cut(moved.union(alone), "roots")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node that it is joined to.

    Every round a node moves to its smallest neighbour, and on to where that one moves, and the links
    are drawn between what they have moved to; those within one node are gone. So the links
    dwindle, in rounds that grow with the logarithm of the longest path; at the end the moves
    are put together, the last ones, which are the fewest, first.
    """
    edges, moves = scratch.cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), []
    every = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    if edges.isEmpty():
        return scratch.cut(every.distinct().withColumn("root", F.col("node")), "roots")
    while moves == [] or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), "up")
        far = keys_for_join(up).select(F.col("node").alias("up"), F.col("up").alias("far"))
        moved = scratch.cut(up.join(far, "up").select("node", F.col("far").alias("root")), "moved")
        moves.append(moved)
        to = keys_for_join(moved)
        drawn = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        drawn = scratch.cut(drawn.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(edges, up)
        edges = drawn
    found = moves.pop()
    while moves:
        later = keys_for_join(found).select(F.col("node").alias("root"), F.col("root").alias("far"))
        found = scratch.cut(moves.pop().join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "roots")
    return found


