"""Fuzzy line deduplication: SimHash blocks, edit similarity, one occurrence per group."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tamarack.llm.common import BLOCK_CHARS, Scratch, blocks, free_names, keys_for_join, map_arrow, pieces, row_key, strings
from tamarack.llm.edit import within
from tamarack.llm.linking import SMALL, Tile, link, shared_members, tiled
from tamarack.llm.near_duplicates import mix

#: Edit similarity (1 - distance / longer length, in characters of normalised lines) from which lines are one.
LEAST_SIMILARITY = 0.8

#: A line of LONG or more words has so many groups of words that each holds 1.5 to 3 of them; the first BLOCKS make a block each.
LONG, BLOCKS, GROUP_WORDS = 12, 8, 1.5
#: A block is joined with those behind it until its words have so many bytes; pairs of blocks of shorter lines need so many.
THIN, THIN_PAIR = 20, 4
#: Blocks of lines of 3 to 11 words, and of lines of up to 3, which are cut into pairs of characters; two blocks make a key.
SHORT_BLOCKS, TINY, TINY_BLOCKS = 4, 3, 6
#: Words of a line are its ruling ones if they make this share of it, where different words are at most RULED of all.
RULING, RULED = 1 / 8, 0.4
#: Lines that share a key are compared if their SimHashes differ in no more bits; of similar lines of documents 99 % differ in 15 at most, of others that share a key a tenth.
MOST_BITS = 18
#: A lane of 8 bits counts at most so many words.
LANE = 255
#: Keys are computed of lines of so many characters at a time, and of less than 2 ** 20 lines.
KEYED_CHARS = BLOCK_CHARS // 4
#: A line in a tile is compared with so many at first; of the pairs of all lines, so many at a time.
FIRST, ASKED = 16, 2048

_ODD, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64
#: What each byte of lower-case UTF-8 becomes: ASCII that is no letter or digit a space, line ends themselves.
_PLAIN = bytes(b if b == 10 or b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Digits are alike in features, but not where lines are compared.
_ALIKE = bytes(48 if 48 <= b < 58 else b for b in range(256))


def normalise(*texts: str) -> list[bytes]:
    """Each line of the texts in turn, in lower case, ASCII marks and white space as single spaces; lines are as many as ``\\n``-split ones."""
    codes = np.frombuffer(b"\n".join([b"", *[text.lower().encode() for text in texts], b""]).translate(_PLAIN), np.uint8)
    space = codes == 32
    codes = codes[np.r_[True, ~(space[1:-1] & (codes[2:] <= 32)), True]]  # the last space of each run is left, unless a line ends there
    codes = codes[np.r_[True, ~((codes[1:-1] == 32) & (codes[:-2] == 10)), True]]
    return codes[1:-1].tobytes().split(b"\n")


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64; kept for the next block, so ``n`` is a round number that most blocks share."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, x, _U))]) for x in (base, pow(base, -1, 2**64)))


def _words(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of bytes and line of every word, digits alike; from sums of bytes times powers over all lines at once."""
    data = b"\n".join([b"", *lines, b""]).translate(_ALIKE)
    codes = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero((codes == 32) | (codes == 10))
    start, end, line = gaps[:-1] + 1, gaps[1:], np.cumsum(codes[gaps[:-1]] == 10) - 1
    some = end > start
    start, end, line = start[some], end[some], line[some]
    power, inverse = (x[: len(codes)] for x in _powers(max(4 * KEYED_CHARS, 1 << (len(codes) - 1).bit_length())))
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * power, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U)), end - start, line


def sim_hash(group: np.ndarray, hashes: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The sorted different groups, and of each a SimHash: 64 bits, each set where more than half of its features have it.

    Bits are summed eight at a time, in the byte lanes of 64-bit integers. With ``whole``, a rising
    number for each group number, also the sorted different wholes and the SimHash of each over
    its groups together, which are at most LANE and summed in lanes of 16 bits.
    """
    if (group[1:] < group[:-1]).any():
        order = np.argsort(group, kind="stable")
        group, hashes = group[order], hashes[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    if len(rank) and rank.max() >= LANE:
        group, hashes = group[rank < LANE], hashes[rank < LANE]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size, which = np.diff(np.r_[first, len(group)]), group[first]
    wholes = whole[which] if whole is not None else which[:0]
    wholes = wholes[np.r_[True, wholes[1:] != wholes[:-1]][: len(wholes)]]
    out, totals, counts = np.empty(len(first), np.uint64), np.zeros((len(wholes), 64), np.int32), np.zeros(len(wholes), np.int64)
    for at in range(0, len(first), 1 << 12):
        starts, mine = first[at : at + (1 << 12)], slice(at, at + (1 << 12))
        lanes = np.unpackbits(mix(hashes[starts[0] : starts[-1] + size[mine][-1]]).view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, starts - starts[0], axis=0).view(np.uint8)
        out[mine] = np.packbits(sums > (size[mine, None] // 2).astype(np.uint8), axis=1).view(np.uint64)[:, 0]
        if whole is not None:
            owners = whole[which[mine]]
            begins = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            k = np.searchsorted(wholes, owners[begins])
            totals[k] += np.add.reduceat(sums.astype(np.uint16).view(np.uint64), begins, axis=0).view(np.uint16)
            counts[k] += np.add.reduceat(size[mine], begins)
    if whole is None:
        return which, out
    return which, out, wholes, np.packbits(2 * totals > counts[:, None], axis=1).view(np.uint64).ravel()


def _pairs(table: np.ndarray, held: np.ndarray, least: int, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys of each two blocks of a table that hold enough together."""
    for a, b in itertools.combinations(range(table.shape[1]), 2):
        ok = np.flatnonzero(held[:, a] + held[:, b] >= least)
        yield ok, mix(mix(table[ok, a] + _U(salt + 16 * a + b)) ^ table[ok, b])


def block_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which line each key belongs to, the keys (hashes of the blocks of the lines' SimHashes), and the SimHash of all blocks of that division.

    Features (the different words, digits alike) are dealt to groups by their hashes, and a block
    is the SimHash of a group. So an edit moves only the blocks of the words that it changes, and
    by the pigeonhole principle a block is left whenever fewer features change than there are
    blocks. (Blocks of one SimHash over all features would all move.) A line whose number of
    words is near the next step has the blocks of that step too, so neighbours share a division. Lines of
    few words, and keys of ruling words, have no SimHash to compare (0).
    """
    hashes, size, owner = _words(lines)
    n = np.bincount(owner, minlength=len(lines))
    dealt = hashes * _ODD
    order = np.argsort(owner.astype(_U) << _U(44) | dealt >> _U(20))  # once, so that the words of each block are beside each other
    owner, dealt = owner[order], dealt[order]
    first = np.flatnonzero(np.r_[True, (dealt[1:] != dealt[:-1]) | (owner[1:] != owner[:-1])][: len(owner)])
    times, order = np.diff(np.r_[first, len(owner)]), order[first]
    owner, dealt, hashes, size = owner[first], dealt[first], hashes[order], size[order]  # the different words of each line
    who, keys, bits_of = [], [], []

    step = np.floor(np.log2(np.maximum(n, 1) / GROUP_WORDS)).astype(np.int64)
    near = np.floor(np.log2(np.maximum(n, 1) / 0.8 / GROUP_WORDS)).astype(np.int64)
    lowest = int(np.log2(LONG / GROUP_WORDS))
    for level in (np.where(n >= LONG, step, 0), np.where((n >= 0.8 * LONG) & (near > step) | (n < LONG) & (n >= 0.8 * LONG), np.maximum(near, lowest), 0)):
        mine = np.flatnonzero(level)
        row = np.full(len(lines), -1)
        row[mine] = np.arange(len(mine))
        shift = _U(64) - np.maximum(level, 1).astype(_U)
        end = np.where(level > lowest, _U(BLOCKS) << shift, np.where(level > 0, ~_U(0), _U(0)))  # of the words of the first BLOCKS groups
        used = np.flatnonzero(dealt < end[owner])
        its = owner[used]
        at, length = row[its] * BLOCKS + (dealt[used] >> shift[its]).astype(np.int64), size[used]
        where, bits, wholes, sketch = sim_hash(at, hashes[used], np.arange(len(mine) * BLOCKS) // BLOCKS)
        table, drawn = np.zeros((len(mine), BLOCKS), _U), np.zeros(len(mine), _U)
        table.ravel()[where], drawn[wholes] = bits, sketch
        held = np.bincount(at, length, len(mine) * BLOCKS).reshape(-1, BLOCKS)
        made, have = mix(table ^ mix(np.arange(1, BLOCKS + 1, dtype=_U) + _U(16) * level[mine][:, None].astype(_U))), held.ravel().copy()
        for k in range(1, BLOCKS):
            thin = np.flatnonzero(have < THIN)
            behind = thin - thin % BLOCKS + (thin + k) % BLOCKS
            made.ravel()[thin] = mix(made.ravel()[thin] ^ mix(table.ravel()[behind] + _U(k)))
            have[thin] += held.ravel()[behind]
        filled = np.nonzero(held)[0]
        who.append(mine[filled])
        keys.append(made[held > 0])
        bits_of.append(drawn[filled])

    mine = np.flatnonzero((n >= TINY) & (n < LONG))
    row = np.full(len(lines), -1)
    row[mine] = np.arange(len(mine))
    used = np.flatnonzero(row[owner] >= 0)
    at, length = row[owner[used]] * SHORT_BLOCKS + (dealt[used] >> _U(62)).astype(np.int64), size[used]
    table, drawn = np.zeros((len(mine), SHORT_BLOCKS), _U), np.zeros(len(mine), _U)
    where, bits, wholes, sketch = sim_hash(at, hashes[used], np.arange(table.size) // SHORT_BLOCKS)
    table.ravel()[where], drawn[wholes] = bits, sketch
    for ok, made in _pairs(table, np.bincount(at, length, table.size).reshape(table.shape), THIN_PAIR, 1 << 12):
        who.append(mine[ok])
        keys.append(made)
        bits_of.append(drawn[ok])

    mine = np.flatnonzero((n <= TINY) & (n > 0))
    codes = [np.frombuffer(b" ".join([b"", lines[k].translate(_ALIKE), b""]).decode().encode("utf-32-le"), "<u4").astype(_U) for k in mine]
    two = mix(np.concatenate([c[:-1] << _U(32) | c[1:] for c in codes] or [np.zeros(0, _U)]))
    at = np.repeat(np.arange(len(mine)), [len(c) - 1 for c in codes]) * TINY_BLOCKS + (two % _U(TINY_BLOCKS)).astype(np.int64)
    table = np.zeros((len(mine), TINY_BLOCKS), _U)
    where, bits = sim_hash(at, two)
    table.ravel()[where] = bits
    chars = np.array([len(c) for c in codes], _U)
    for ok, made in _pairs(table, np.bincount(at, minlength=table.size).reshape(table.shape), 1, 1 << 13):
        for more in (0, 1):  # lengths that differ by one meet
            who.append(mine[ok])
            keys.append(mix(made + chars[ok] + _U(more)))
            bits_of.append(np.zeros(len(ok), _U))

    used = np.flatnonzero(n[owner] >= LONG)
    times, h, o = times[used], hashes[used], owner[used]
    ruling = (np.bincount(o, minlength=len(lines)) <= RULED * n)[o] & (times >= RULING * n[o])
    total = np.zeros(len(lines), _U)
    np.add.at(total, o[ruling], mix(h[ruling]))
    mine = np.flatnonzero(total)
    return np.concatenate([*who, mine]), np.concatenate([*keys, mix(total[mine])]), np.concatenate([*bits_of, np.zeros(len(mine), _U)])


def similar(a: list[str], b: list[str]) -> list[bool]:
    """Whether the edit similarity of each two lines is LEAST_SIMILARITY or more."""
    return within(a, b, 1 - LEAST_SIMILARITY)


def _lines(keyed: DataFrame) -> DataFrame:
    """Of every line with a word: row, id, line (from 0), whether it is the first of its text, node, size, keys with their bits, and form."""
    names = ["row", "id", "line", "first", "node", "size", "keys", "bits", "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in pieces(batches):
            rows, ids, texts = batch.column(0).to_pylist(), batch.column(1), strings(batch.column(2))
            for a, b in blocks(texts):
                every = iter(normalise(*texts[a:b]))
                found = [(k, n, line) for k in range(a, b) for n, line in enumerate(itertools.islice(every, texts[k].count("\n") + 1)) if line]
                forms = [x[2] for x in found]
                for c, d in blocks(forms, KEYED_CHARS):
                    who, keys, bits = block_keys(forms[c:d])
                    order = np.argsort(who, kind="stable")
                    ends = pa.array(np.r_[0, np.cumsum(np.bincount(who, minlength=d - c))], pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].view(np.int64))) for x in (keys, bits)]
                    part, form = found[c:d], pa.array(forms[c:d], pa.binary()).cast(pa.string())
                    first = [k + c == 0 or found[k + c - 1][0] != x[0] for k, x in enumerate(part)]
                    arrays = [pa.array([rows[x[0]] for x in part], pa.binary()), ids.take(pa.array([x[0] for x in part], pa.int64())), pa.array([x[1] for x in part], pa.int32()), pa.array(first, pa.bool_()), pa.array(map(digest, forms[c:d]), pa.binary()), pa.compute.utf8_length(form), *lists, form]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = keyed.schema["id"].dataType.simpleString()
    return map_arrow(keyed.select("row", "id", "text"), run, f"row binary, id {kind}, line int, first boolean, node binary, size int, keys array<long>, bits array<long>, form string")


class _Verifier:
    """Edit similarity of pairs of candidates, whose forms are set apart once."""

    def __init__(self, lines: DataFrame, scratch: Scratch):
        self.lines, self.scratch = lines, scratch

    def prepare(self, candidates: DataFrame) -> Callable[[DataFrame], DataFrame]:
        wanted = self.scratch.cut(candidates.select(F.xxhash64("node").alias("mark")).distinct(), "wanted")
        forms = self.lines.select(F.xxhash64("node").alias("mark"), "node", "form").join(keys_for_join(wanted), "mark", "left_semi")
        self.forms = self.scratch.cut(forms.groupBy("node").agg(F.any_value("form").alias("form")), "forms")
        self.scratch.drop(self.lines, wanted)
        return self.verify

    def verify(self, pairs: DataFrame) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

        one, two = self.forms.select(F.col("node").alias("a"), F.col("form").alias("x")), self.forms.select(F.col("node").alias("b"), F.col("form").alias("y"))
        return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), compare, "a binary, b binary")

    def beyond(self, large: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All links between different roots of open large groups, each compared as a whole, in tiles."""
        return tiled(large, self.forms.withColumnRenamed("form", "value"), _linked, self.scratch)


def _fits() -> Column:
    """Lengths and SimHashes that similar lines may have."""
    near = (F.col("bits_a") == 0) | (F.col("bits_b") == 0) | (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= MOST_BITS)
    return (F.least("size_a", "size_b") + F.lit(1e-6) >= F.lit(LEAST_SIMILARITY) * F.greatest("size_a", "size_b")) & near


def _linked(tile: Tile, forms: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of a tile that fit, are similar and join roots; each line is compared with some, and with more while it is not joined to their roots."""
    none, left, some = tile.bits == 0, {}, FIRST
    for x in tile.asking.tolist():
        y = tile.open(x)
        size, own = tile.size[y], tile.size[x]
        near = none[y] | none[x] | (np.bitwise_count(tile.bits[y] ^ tile.bits[x]) <= MOST_BITS)
        left[x] = y[near & (np.minimum(size, own) + 1e-6 >= LEAST_SIMILARITY * np.maximum(size, own))]
    while left:
        asked = [(x, k) for x, y in left.items() for k in y[:some].tolist()]
        for at in range(0, len(asked), ASKED):
            pairs = [(x, y) for x, y in asked[at : at + ASKED] if tile.root[x] != tile.root[y]]
            hit = similar([forms[x] for x, _ in pairs], [forms[y] for _, y in pairs])
            yield from (p for p, h in zip(pairs, hit, strict=True) if h and tile.join(*p))
        left = {x: y for x, y in ((x, tile.open(x, y[some:])) for x, y in left.items() if len(y) > some) if len(y)}
        some *= 4


def _removed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """row -> the numbers of its lines that another occurrence stands for, written; and the rows that repeat."""
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = scratch.cut(_lines(keyed), "lines")
    repeated = lines.where("first").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    repeated = scratch.cut(repeated, "repeated")
    places = scratch.cut(lines.select("row", "id", "line", "node"), "places")
    members = shared_members(lines.select("node", "size", "keys", "bits"), scratch)
    verifier = _Verifier(lines, scratch)
    roots = link(members, verifier.prepare, scratch, fits=_fits(), beyond=verifier.beyond, small=SMALL)
    rooted = places.join(keys_for_join(roots), "node", "left").select("row", "id", "line", F.coalesce("root", "node").alias("root"))
    mark = F.xxhash64("root")
    several = rooted.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).where("n > 1").select("mark")
    met = rooted.withColumn("mark", mark).join(keys_for_join(scratch.cut(several, "several")), "mark", "left_semi").drop("mark")
    met = scratch.cut(met, "met")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "row", "line")
    kept = met.groupBy("root").agg(F.min(place).alias("kept")).select("root", F.col("kept.row").alias("kept_row"), F.col("kept.line").alias("kept_line"))
    kept = scratch.cut(kept, "kept")
    gone = met.join(keys_for_join(kept), "root").where("row != kept_row OR line != kept_line")
    gone = scratch.cut(gone.groupBy("row").agg(F.collect_set("line").alias("gone")), "gone")  # of one text
    scratch.drop(places, members, roots, met, kept)
    return gone, repeated


#: Which bytes make a line one that counts; that the line has one is seen from so many first ones, if not from all.
_COUNTS, SEEN = np.array([b > 32 for b in _PLAIN]), 16


def count_lines(texts: pa.Array) -> np.ndarray:
    """How many lines of each text have a letter or digit, from the bytes of all texts at once; null counts as the empty text."""
    coded = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded) + 1]
    codes = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(codes) == 0:
        return np.zeros(len(texts), np.int64)
    starts = np.sort(np.r_[ends[:-1], np.flatnonzero(codes == 10) + 1])
    starts = starts[np.r_[True, starts[1:] != starts[:-1]] & (starts < len(codes))]  # an empty line at the end is none
    some, left, stops = np.zeros(len(starts), bool), np.arange(len(starts)), np.r_[starts[1:], len(codes)]
    for k in range(SEEN):
        some[left] = _COUNTS[codes[starts[left] + k]]
        left = left[~some[left] & (starts[left] + k + 1 < stops[left])]
    for k in left.tolist():
        some[k] = _COUNTS[codes[starts[k] + SEEN : stops[k]]].any()
    return np.bincount(np.searchsorted(ends, starts[some], side="right") - 1, minlength=len(texts))


#: The lines to be removed are sent to every task up to so many rows with so many lines.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 2_000_000


def _later_copies(keyed: DataFrame, repeated: DataFrame, others: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``\x01copy``: whether another row of the same row key comes first (by a hash of all columns, then as written)."""
    marked = keyed.withColumn("\x01hash", F.xxhash64(*others)).withColumn("\x01place", F.monotonically_increasing_id())
    several = scratch.cut(marked.join(keys_for_join(repeated.withColumnRenamed("row", "\x01row")), "\x01row", "left_semi"), "copies")
    single = keyed.join(keys_for_join(repeated.withColumnRenamed("row", "\x01row")), "\x01row", "left_anti")
    first = several.groupBy("\x01row").agg(F.min(F.struct("\x01hash", "\x01place")).alias("\x01first"))
    told = several.join(keys_for_join(scratch.cut(first, "first-copies")), "\x01row").withColumn("\x01copy", F.struct("\x01hash", "\x01place") != F.col("\x01first"))
    return single.withColumn("\x01copy", F.lit(False)).unionByName(told.drop("\x01hash", "\x01place", "\x01first"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lines removed that another occurrence stands for, and added n_lines and n_removed.

    Lines are split at ``\\n`` and normalised; equal forms are one node, and nodes are linked that
    share a key of :func:`block_keys` and have an edit similarity of LEAST_SIMILARITY or more. Of
    each connected group the occurrence of the smallest (id, text key, line number) stays,
    wherever it is; all others go, in their document too. Lines without letters or digits are no
    lines: they stay and are not counted.

    Null texts stay null and have no lines; null ids come last. Of rows that repeat in id and
    text, the first by a hash of all their columns (as they were read, among equal ones) is
    treated as the first, and the others lose every counted line. A very long line is compared
    whole, and a very long text handled a block of lines at a time. An empty table gives no row;
    an added name that exists gets an underscore.
    """
    added = free_names(docs.columns, ["n_lines", "n_removed"])
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone, repeated = _removed(docs, id_col, text_col, scratch)
    few = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    gone = gone.withColumnRenamed("row", "\x01row").withColumnRenamed("gone", "\x01gone")
    gone = F.broadcast(gone) if few["rows"] <= BROADCAST_ROWS and few["lines"] <= BROADCAST_LINES else gone
    keyed = docs.withColumn("\x01row", row_key(F.col(id_col), F.col(text_col)))
    marked = keyed.withColumn("\x01copy", F.lit(False)) if repeated.isEmpty() else _later_copies(keyed, repeated, docs.columns, scratch)
    placed = marked.join(gone, "\x01row", "left")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            numbers, copy = batch.column(len(names)), batch.column(len(names) + 1)
            counts, lost = count_lines(batch.column(at)), np.zeros(len(batch), np.int64)
            met = pa.compute.or_(numbers.is_valid(), copy)  # the texts of all others stay where they are
            texts = []
            for k, text, gone, again in zip(np.flatnonzero(met.to_numpy(zero_copy_only=False)).tolist(), *[c.filter(met).to_pylist() for c in (batch.column(at), numbers, copy)], strict=True):
                out = {n for n, line in enumerate(normalise(text or "")) if line} if again else set(gone)
                texts.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in out) if out else text)
                lost[k] = len(out)
            columns = [pa.compute.replace_with_mask(c, met, pa.array(texts, c.type)) if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(lost)], names=[*names, *added])

    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in added]])
    return map_arrow(placed.select(*names, "\x01gone", "\x01copy"), run, schema)


def drop_emptied(deduped: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of :func:`dedup_lines`' rows, without documents that lost every counted line."""
    lines, removed = free_names(columns, ["n_lines", "n_removed"])
    return deduped.where((F.col(lines) == 0) | (F.col(lines) > F.col(removed))).select(*columns)
