import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import line_dedup as L
from tamarack.llm import linking
from tamarack.llm.common import pieces
from tamarack.llm.edit import aligned, distance, least_distances, symbol_distances, within

SCHEMA = "doc_id long, text string, line int, n string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(0, 14))
def test_distance(a, b, most):
    d = distance(a, b, most)
    assert d == edits(a, b) if edits(a, b) <= most else d > most


def test_within():
    """Of all lengths around 64, with characters beyond the first plane."""
    rng = random.Random(5)
    a, b = [], []
    for k in range(600):
        alphabet = rng.choice(["ab", "abcdefgh ", "aé漢🙂"])
        x = [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 127, 128, 129, 200]))]
        y = list(x)
        for _ in range(rng.randint(0, 2 + len(x) // 3)):
            at = rng.randint(0, len(y))
            y[at : at + rng.choice([0, 1, 1, 2])] = rng.choice(["", rng.choice(alphabet), "zz"])
        a.append("".join(x))
        b.append("".join(y) if k % 5 else "".join(rng.choice(alphabet) for _ in x))
    want = [edits(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert within(a, b, 0.2) == want and 100 < sum(want) < 550
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    assert within([long, long, ""], [long[:2000] + long[2900:], long[:2000] + long[3100:], ""], 0.2) == [True, False, True]


def test_aligned_words():
    """What an alignment accepts is within the distance, and it accepts most lines with few words changed."""
    rng = random.Random(6)
    words = ["ab", "abc", "b", "ca", "the", "of", "dd", "bad", "cab", ""]
    accepted = 0
    for _ in range(600):
        x = rng.choices(words, k=rng.randint(0, 30))
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(y))
            y[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(words)]])
        a, b = " ".join(x), " ".join(y)
        d = edits(a, b)
        for most in (0, 3, 10, 40):
            assert d <= most or not aligned(a, b, most)
            assert (distance(a, b, most) == d) if d <= most else distance(a, b, most) > most
        accepted += d <= 10 and aligned(a, b, 10)
    assert accepted > 200


def test_bounds_of_many_pairs():
    """Of texts of all lengths around 64 and 128: exact where each character has a symbol of its own, never above the distance elsewhere."""
    rng = random.Random(7)
    for alphabet in ("ab ", "abcdefghijklmnop 0123", "aé漢🙂xб٣\n-"):
        a = ["".join(rng.choices(alphabet, k=rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 200]))) for _ in range(120)]
        b = ["".join(rng.choice(alphabet) if rng.random() < rng.choice([0, 0.1, 0.5]) else c for c in x if rng.random() < 0.9) or "a" for x in a]
        want = np.array([edits(x, y) for x, y in zip(a, b, strict=True)])
        got = symbol_distances(a, b)
        assert (got == want).all() if alphabet.isascii() else (got <= want).all() and got.sum() > want.sum() / 2
        assert (least_distances(a, b) <= want).all() and least_distances(a, b).max() > 10


def test_distances_up_to_a_bound():
    """Exact up to what each pair may have, above it beyond; repetitive texts of thousands of characters too, and as a lower bound where symbols are shared."""
    rng = random.Random(12)
    a, b = [], []
    for k in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(rng.choice([2, 30, 200]))]
        x = " ".join(rng.choices(words, k=rng.choice([2, 12, 40, 90])))
        y = [("" if rng.random() < 0.3 else rng.choice("abcdefgh ")) if rng.random() < rng.choice([0.02, 0.2, 0.25]) else c for c in x]
        a.append(x)
        b.append("".join(y) if k % 4 else " ".join(rng.choices(words, k=x.count(" ") + 1)) or "a")
        b[-1] = b[-1] or "a"
    want = np.array([distance(x, y, max(len(x), len(y))) for x, y in zip(a, b, strict=True)])
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    for share in (0, 0.05, 0.2, 0.6):
        most = (share * longer).astype(int)
        got = symbol_distances(a, b, most)
        assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most[want > most]).all()
    long = [" ".join(rng.choices("abcdefgh", k=4)) + " " for _ in range(60)]
    a, b = [x * 400 for x in long], [x * 380 for x in long[1:]] + [long[0] * 390]
    assert (least_distances(a, b) > [0.2 * len(x) for x in a]).sum() > 40  # without a look at the diagonal
    assert within(a, b, 0.2) == [distance(x, y, len(x) // 5) <= len(x) // 5 for x, y in zip(a, b, strict=True)]
    assert within(["é漢 " * 90] * 40, ["é汉 " * 90] * 40, 0.2) == [False] * 40


def test_keys_of_a_word_that_repeats():
    """Words that are set apart once keep each line's different words: order and repeats do not count below the ruling share."""
    words = [f"w{k}" for k in range(40)]
    assert {k for k in keys_of([" ".join(words).encode()])[0]} == {k for k in keys_of([" ".join(words[::-1]).encode()])[0]}


def test_normalise_and_sim_hash():
    for text in ("", " ", "\n", " \n a \n\n  b\t\tc ", "x  y \r\n  \r\n.", "Ⅳ İ\x1c\x85z\u2028w\x0bq"):
        assert L.normalise(text) == [b" ".join(x.split()) for x in text.lower().encode().translate(L._PLAIN).split(b"\n")]
    assert L.normalise("A1b, c!\n\n ## \r\nÉé  x") == ["a1b c".encode(), b"", b"", "éé x".encode()]
    rng = np.random.default_rng(1)
    hashes, group = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 9, 900) * 5
    hashes, group = np.append(hashes, rng.integers(0, 2**63, 400).astype(np.uint64)), np.append(group, np.full(400, 77))
    which, got = L.sim_hash(group, hashes)
    assert which.tolist() == sorted(set(group.tolist()))
    for g, bits in zip(which, got, strict=True):
        mine = L.mix(hashes[group == g][: L.LANE])
        votes = np.unpackbits(mine[:, None].view(np.uint8), axis=1).sum(0)
        assert np.packbits(2 * votes > len(mine)).view(np.uint64)[0] == bits
    _, _, wholes, over = L.sim_hash(group[:900], hashes[:900], np.arange(100) // 10)
    assert wholes.tolist() == [0, 1, 2, 3, 4] and (over == L.sim_hash(group[:900] // 10, hashes[:900])[1]).all()
    assert len(L.sim_hash(group[:0], hashes[:0])[1]) == 0


def test_texts_together_and_powers_kept():
    """Lines of several texts are those of each, and blocks of different sizes share the powers that word hashes are made of."""
    texts = ["a  b,\n\n c ", "", " \n", "x", "Σ ΑΣ\n.. d.", "\n"]
    assert L.normalise(*texts) == [line for text in texts for line in L.normalise(text)]
    L._powers.cache_clear()
    for n in (3, 3000, 40, 20_000, 3):
        L.block_keys([b"some words of a line"] * n)
    assert L._powers.cache_info().misses == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text("a\n .-\ré漢1", max_size=40), max_size=6), st.integers(0, 3))
def test_count_lines(texts, skipped):
    want = [sum(map(bool, L.normalise(text or ""))) for text in texts]
    assert L.count_lines(pa.array(texts, pa.string())[skipped:]).tolist() == want[skipped:]


def test_members_have_the_bits_of_their_keys(spark):
    """Also where keys of a node are not shared, or shared by copies of the node only."""
    rows = [(b"a", 5, [1, 2, 3], [10, 20, 30]), (b"a", 5, [1, 2, 3], [10, 20, 30]), (b"b", 6, [9, 3, 4], [0, 31, 0]), (b"c", 7, [], []), (b"d", 8, [4, 7], [41, 71])]
    scratch = linking.Scratch(spark, "members")
    nodes = scratch.cut(spark.createDataFrame(rows, "node binary, size int, keys array<long>, bits array<long>"), "nodes")
    found = linking.shared_members(nodes, scratch)
    assert found.columns == ["key", "node", "size", "bits"]
    assert sorted((r.key, bytes(r.node), r.size, r.bits) for r in found.collect()) == [(3, b"a", 5, 30), (3, b"b", 6, 31), (4, b"b", 6, 0), (4, b"d", 8, 41)]
    assert {r.bits for r in linking.shared_members(nodes.drop("bits"), scratch).collect()} == {0}


def keys_of(lines):
    """Key -> bits, of each line."""
    found = [{} for _ in lines]
    for k, key, bits in zip(*(x.tolist() for x in L.block_keys(lines)), strict=True):
        found[k][key] = bits
    return found


def meet(x, y):
    return any(not (x[k] and y[k]) or (x[k] ^ y[k]).bit_count() <= L.MOST_BITS for k in x.keys() & y.keys())


def test_keys_do_not_depend_on_what_stands_beside():
    lines = [b"a", b"one two three", b"a b c d e f g h i j k l m n", b"x " * 300 + b"y z", " ".join(f"w{k}" for k in range(700)).encode(), "é".encode()]
    assert keys_of(lines) == [keys_of([x])[0] for x in lines] and L.block_keys([])[0].size == 0
    assert all(keys_of(lines)) and keys_of([b"at 10 of 12"]) == keys_of([b"at 73 of 99"])


@pytest.mark.parametrize("words,least", [((5, 7), 0.85), ((8, 11), 0.9), ((12, 17), 0.9), ((18, 30), 0.9), ((31, 100), 0.9)])
def test_recall_of_one_replaced_word(words, least):
    """Of ordinary lines in which any one word is replaced, the two being similar; shorter lines than this allow no word to change."""
    rng = random.Random(words[0])
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.choice([2, 3, 5, 7, 9]))) for _ in range(3000)]
    common = vocabulary[:40]
    pairs = []
    while len(pairs) < 300:
        line = [rng.choice(common if rng.random() < 0.4 else vocabulary) for _ in range(rng.randint(*words))]
        other = list(line)
        other[rng.randrange(len(line))] = rng.choice(vocabulary)
        if other != line and all(L.similar([" ".join(line)], [" ".join(other)])):
            pairs.append((" ".join(line).encode(), " ".join(other).encode()))
    found = keys_of([x for p in pairs for x in p])
    assert sum(meet(found[2 * k], found[2 * k + 1]) for k in range(len(pairs))) >= least * len(pairs)


def test_recall_of_all_similar_pairs_of_documents(spark):
    """Against edit similarity alone, over every pair of lines of the smallest table; joined by others counts too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    forms = sorted({f.decode() for _, t in rows for f in L.normalise(t or "") if f}, key=len)
    bags = np.stack([np.bincount(np.frombuffer(f.encode("utf-32-le"), "<u4") % 61, minlength=61) for f in forms]).astype(np.int16)
    pairs = []
    for k, x in enumerate(forms):
        end = next((j for j in range(len(forms) - 1, k, -1) if len(forms[j]) * 0.8 <= len(x) + 1e-9), k) + 1
        differ = bags[k + 1 : end] - bags[k]
        for j in np.flatnonzero(np.maximum(np.maximum(differ, 0).sum(1), np.maximum(-differ, 0).sum(1)) <= [int(0.2 * len(f) + 1e-9) for f in forms[k + 1 : end]]) + k + 1:
            if all(L.similar([x], [forms[j]])):
                pairs.append((x, forms[j]))
    _, owner = brute(rows)
    group = {f.decode(): owner[i, n] for i, t in rows for n, f in enumerate(L.normalise(t or "")) if f}
    assert len(pairs) > 10 and sum(group[x] == group[y] for x, y in pairs) >= 0.9 * len(pairs)
    got = {r.doc_id: r.n_removed for r in L.dedup_lines(docs).collect()}
    kept, _ = brute(rows)
    assert sum(got.values()) == sum(sum(map(bool, L.normalise(t or ""))) for _, t in rows) - len(kept)


def brute(rows):
    """The same rule over all pairs of forms that share a key."""
    places = [(i is None, i or 0, t or "", n, i, form) for i, t in rows for n, form in enumerate(L.normalise(t or "")) if form]
    forms = sorted({p[5] for p in places})
    number = {f: k for k, f in enumerate(forms)}
    by_key = {}
    known = keys_of(forms)
    for k, keys in enumerate(known):
        for key in keys:
            by_key.setdefault(key, []).append(k)
    parent = list(range(len(forms)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in {(a, b) for group in by_key.values() for k, a in enumerate(group) for b in group[:k]}:
        x, y = forms[a].decode(), forms[b].decode()
        if meet(known[a], known[b]) and distance(x, y, most := int(0.2 * max(len(x), len(y)) + 1e-9)) <= most:
            parent[root(a)] = root(b)
    kept = {}
    for p in sorted(places, key=lambda p: p[:2]):
        kept.setdefault(root(number[p[5]]), []).append(p)
    return {g: {(p[4], p[3]) for p in v if p[:2] == v[0][:2]} for g, v in kept.items()}, {(p[4], p[3]): root(number[p[5]]) for p in places}


def test_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    bases = [[word() for _ in range(n)] for n in (3, 8, 20, 60)]
    rows = []
    for k in range(90):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = word()
            lines.append(rng.choice(["", "## ", "  "]) + " ".join(line) + rng.choice(["", ".", " 1"]))
            if k % 9 == 0:
                lines.append(rng.choice(["", "---", " "]))
        rows.append((k, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "only here with a null id\n" + " ".join(bases[2]))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in L.dedup_lines(df.withColumnRenamed("n", "extra")).collect()}
    kept, owner = brute(rows)
    left = {}
    for doc, text in rows:
        r = got[doc]
        forms = L.normalise(text or "")
        assert r.n_lines == sum(map(bool, forms)) and r.extra == "x" and (text is None) == (r.text is None)
        if text is None:
            continue
        said = r.text.split("\n")
        assert r.n_lines - r.n_removed == sum(map(bool, L.normalise(r.text))) and all(x in said for x, f in zip(text.split("\n"), forms, strict=True) if not f) or r.n_removed == r.n_lines
        for n, (x, f) in enumerate(zip(text.split("\n"), forms, strict=True)):
            if f and x in said:
                left.setdefault(owner[doc, n], set()).add(doc)
    assert set(left) == set(kept) and all(len(v) == 1 and v == {d for d, _ in kept[g]} for g, v in left.items())


def test_repeated_rows_and_edges(spark):
    df = spark.createDataFrame([(1, "same line of words here\nother words of it", 1, "x")] * 3 + [(2, "x " * 100_000, 1, "x")], SCHEMA).withColumnRenamed("n", "m")
    got = sorted((r.doc_id, r.text or "", r.n_removed) for r in L.dedup_lines(df).collect())
    assert got[:3] == [(1, "", 2), (1, "", 2), (1, "same line of words here\nother words of it", 0)] and got[3][2] == 0
    assert L.dedup_lines(df.limit(0)).count() == 0
    assert L.dedup_lines(df.withColumnRenamed("m", "n_LINES")).columns[3:] == ["n_LINES", "n_lines_", "n_removed"]


def test_rows_equal_in_id_and_text(spark):
    text = "a line that all of these rows have\nand another line of theirs"
    rows = [(1, text, k % 3, "x") for k in range(30)]
    for parts in (1, 7):
        got = L.dedup_lines(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n", "m").repartition(parts)).collect()
        left = [r for r in got if r.n_removed == 0]
        assert len(got) == 30 and len(left) == 1 and left[0].text == text and all(r.text == "" for r in got if r.n_removed)
        first = left[0].line if parts == 1 else first
        assert left[0].line == first


def test_open_large_groups_by_a_second_block(spark, monkeypatch):
    """Families that share blocks of words with others, in groups that are larger than the bound for pairs."""
    monkeypatch.setattr(L, "SMALL", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(24)]
    lines = []
    for _ in range(25):
        own = list(base)
        for k in rng.sample(range(24), 10):
            own[k] = word()
        other = list(own)
        other[rng.randrange(24)] = word()
        lines += [" ".join(own), " ".join(other)]
    rows = list(enumerate(lines))
    kept, _ = brute(rows)
    got = L.dedup_lines(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).withColumnRenamed("n", "m")).collect()
    assert sum(r.n_removed for r in got) == len(lines) - len(kept) and len(kept) <= 26


def crowd(seed, couples):
    """Lines that share one block, of three words; the two of a couple have most of their other words in common, in which they are like no other line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    group = lambda w: int((L._words([w.encode()])[0] * L._ODD)[0]) >> 60  # noqa: E731  of lines of 24 to 47 words
    pick = lambda ok: next(w for w in iter(word, None) if ok(group(w)))
    base, lines = [pick(lambda g: g == 3) for _ in range(3)], []
    for _ in range(couples):
        own = base + [pick(lambda g: g != 3) for _ in range(21)]
        other = list(own)
        for k in rng.sample(range(3, 24), 4):
            other[k] = pick(lambda g: g != 3)
        lines += [" ".join(own), " ".join(other)] if L.similar([" ".join(own)], [" ".join(other)]) == [True] else []
    return lines


def single_key_links(lines):
    """How many links there are whose two lines share one key only."""
    found = keys_of([x.encode() for x in lines])
    shared = [(a, b, x.keys() & y.keys()) for a, x in enumerate(found) for b, y in enumerate(found[:a])]
    return sum(len(s) == 1 and meet(found[a], found[b]) and all(L.similar([lines[a]], [lines[b]])) for a, b, s in shared)


@pytest.mark.parametrize("part", [40, 4096])
def test_open_large_groups_lose_no_link(spark, monkeypatch, part):
    """Also those of two lines that share only one key, of a group above the bound for pairs, in one tile and in several."""
    monkeypatch.setattr(L, "tiled", lambda *a: linking.tiled(*a, part=part))
    lines = crowd(11, 150)
    rows = list(enumerate(lines))
    kept, _ = brute(rows)
    assert single_key_links(lines) > 3 and max(Counter(k for x in keys_of([x.encode() for x in lines]) for k in x).values()) > L.SMALL
    got = L.dedup_lines(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).withColumnRenamed("n", "m")).collect()
    assert {r.doc_id for r in got if not r.n_removed} == {d for v in kept.values() for d, _ in v}


def test_pieces_of_batches():
    """All rows in their order, in batches of bounded bytes; a larger row is alone, an empty batch gives none."""
    texts = ["x" * n for n in (10, 0, 5000, 20, 9000)] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    got = list(pieces(iter([batch, batch.slice(0, 0)]), 30_000))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts and all(sum(map(len, b.column(1).to_pylist())) <= 60_000 for b in got)
    assert len(got) > 10 and [b.num_rows for b in pieces(iter([batch]), 1)] == [1] * len(texts)
    assert max(b.num_rows for b in pieces(iter([batch]))) == len(texts)
