import random

import numpy as np
import pytest

from tamarack.llm import linking
from tamarack.llm import near_duplicates as N
from tamarack.llm.common import Scratch

SCHEMA = "doc_id long, text string, node string, class_id long"


def probability_jaccard(x, y):
    total = 0.0
    for i in set(x) & set(y):
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y))
    return total


@pytest.mark.parametrize("n", [1, 3, 40, 600])
def test_estimates_probability_jaccard(n):
    rng = np.random.default_rng(n)
    x = {int(k): float(1 + np.log(rng.integers(1, 9))) for k in range(1, n + 1)}
    y = {k + (1000 if k % 4 == 0 else 0): w * (2 if k % 5 == 0 else 1) for k, w in x.items()}
    sets = [(np.array(list(s), np.uint64), np.array(list(s.values()))) for s in (x, y)]
    a, b = N.prob_min_hash(sets, 4096)
    assert (a == b).mean() == pytest.approx(probability_jaccard(x, y), abs=0.04)
    assert (N.prob_min_hash(sets[1:] * 2, 4096) == b).all()  # whatever stands beside it


def brute(rows):
    def cut(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [cut(t) for _, t in rows], list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    by = {}
    for k, (doc, _) in enumerate(rows):
        by.setdefault(root(k), []).append(doc)
    return sorted(sorted(map(str, v)) for v in by.values())


def family(seed, copies, words=150):
    """Copies of one text with up to ten words changed, some copied again; the pairs of most do not meet the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(words)]
    made = [base]
    for k in range(copies):
        text = list(rng.choice(made) if k % 3 == 0 else base)
        for _ in range(rng.randint(0, 10)):
            text[rng.randrange(words)] = word()
        made.append(text)
    return [" ".join(t) for t in made]


@pytest.mark.parametrize("small", [8, 256])
def test_classes_of_large_families(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    texts = family(1, 220) + family(2, 60) + family(3, 3) + [" ".join(t.split()[:120]) for t in family(4, 5)]
    rng = random.Random(9)
    rows = list(enumerate(texts)) + [(1000 + k, texts[7]) for k in range(40)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "three word text"), (2004, "three word text"), (2005, "word " * 50_000), (3, texts[3]), (None, texts[285])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], SCHEMA)
    found = N.near_duplicates(df).collect()
    by = {}
    for r in found:
        by.setdefault((r.class_id), []).append(r.id)
    assert sorted(sorted(map(str, v)) for v in by.values()) == brute(rows)
    assert all(r.class_docs == len(by[r.class_id]) and r.class_id == min(x for x in by[r.class_id] if x is not None) for r in found)
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(by)


def around_a_passage(seed, couples, common=110, own=14, kept=1):
    """Texts around one passage, not similar enough by it; the two of a couple also share part of their own words."""
    rng = random.Random(seed)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage, made = say(common), []
    for _ in range(couples):
        both = say(kept)
        made += [" ".join(passage + both + say(own - kept)) for _ in range(2)]
    return made


@pytest.mark.parametrize("small", [8, 256])
def test_couples_around_a_common_passage(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rows = [(k, t) for k, t in enumerate(t for seed in range(3) for t in around_a_passage(seed, 40))]
    want = brute(rows)
    assert len(want) == 120  # couples only
    by = {}
    for r in N.near_duplicates(spark.createDataFrame([(*r, "n", 5) for r in rows], SCHEMA)).collect():
        by.setdefault(r.class_id, []).append(str(r.id))
    assert sorted(sorted(v) for v in by.values()) == want


@pytest.mark.parametrize("part", [16, 1024])
def test_open_large_groups_make_no_row_per_shingle(spark, monkeypatch, part):
    """Rows of tiles are members times parts, in one tile and in several; no link is lost."""
    made, cut = {}, Scratch.cut

    def kept(self, df, name):
        out = cut(self, df, name)
        made.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(N, "SMALL", 8)
    monkeypatch.setattr(N, "tiled", lambda *a: linking.tiled(*a, part=part))
    monkeypatch.setattr(Scratch, "cut", kept)
    monkeypatch.setattr(Scratch, "drop", lambda *a: None)
    rows = list(enumerate(t for seed in range(2) for t in around_a_passage(seed, 40))) + list(enumerate(family(1, 150), 1000))
    by = {}
    for r in N.near_duplicates(spark.createDataFrame([(*r, "n", 5) for r in rows], SCHEMA)).collect():
        by.setdefault(r.class_id, []).append(str(r.id))
    assert sorted(sorted(v) for v in by.values()) == brute(rows)
    large = made["open-large"][0].select("leader", "node").distinct().count()
    wide = {name: max(t.count() for t in tables) for name, tables in made.items() if name not in ("signatures", "members", "rows")}
    assert large > 50 and "prefixes" not in made and made["links-large"][0].count() < large
    assert wide["parts"] <= made["open-large"][0].select("leader").distinct().count()


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in [*range(1, 30), 200, 333]:
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**40, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**40, n // 10).astype(np.uint64)]))
            if len(y) and N.jaccard(x, y) >= N.LEAST_SIMILARITY:
                leader = np.unique(np.concatenate([x[: n // 2], y[n // 3 :]]))
                assert len(np.intersect1d(N.prefix(x, leader), N.prefix(y, leader)))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicates(df).count() == 0 == N.drop_near_duplicates(df).count()
    same = spark.createDataFrame([(1, "a b", "x", 1)] * 3 + [(2, None, "x", 1)] * 2, SCHEMA)
    assert N.drop_near_duplicates(same).count() == 3


@pytest.mark.parametrize("small", [3, 1000])
def test_link_joins_all_that_share_a_key(spark, small):
    """Random chains and families against all pairs; among them members of a leader's family that others only reach through it."""
    rng = random.Random(small)
    value = {k: rng.choice([0, 1, 2, 3, 5, 9, 14, 200]) * 10 + rng.randint(0, 6) for k in range(240)}
    keys = {k: sorted(rng.sample(range(12), rng.randint(1, 3))) for k in value}
    near = lambda a, b: abs(value[a] - value[b]) <= 2
    name = lambda k: bytes([k // 256, k % 256])
    number = {name(k): k for k in value}
    scratch = Scratch(spark, "t")
    nodes = scratch.cut(spark.createDataFrame([(name(k), 10, keys[k]) for k in value] * 2, "node binary, size int, keys array<long>"), "nodes")
    asked = []

    def prepare(candidates):
        def verify(pairs):
            rows = [(r.a, r.b) for r in pairs.collect()]
            asked.extend(rows)
            return spark.createDataFrame([p for p in rows if near(number[p[0]], number[p[1]])], "a binary, b binary")

        return verify

    def beyond(large, members, verify):
        x, y = (large.selectExpr("key", f"node AS {s}", f"root AS root_{s}") for s in "ab")
        return verify(x.join(y, "key").where("a < b AND root_a != root_b").select("a", "b").distinct())

    roots = linking.link(linking.shared_members(nodes, scratch), prepare, scratch, fits=linking.F.lit(True), beyond=beyond, small=small)
    got = {number[r.node]: number[r.root] for r in roots.collect()}
    want = {k: k for k in value}
    for _ in range(len(value)):
        before = dict(want)
        for a in value:
            for b in value:
                if near(a, b) and set(keys[a]) & set(keys[b]):
                    want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    assert {k: got.get(k, k) for k in value} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in linking.components(df, Scratch(spark, "t")).collect()}
    want = {k: k for e in edges for k in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
