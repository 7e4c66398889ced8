import random
import re

import duckdb

from tamarack.llm import decontaminate as D
from tamarack.llm import queries

WORDS = [a + b for a in "bcdfglmnprst" for b in ("an", "el", "io", "ur", "ata", "eno")]


def words(text):
    return [w for w in re.split(r"[^a-zé0-9]+", (text or "").lower()) if w]


def brute(docs, items):
    """Every aligned placement of every item against every document, by definition."""
    found = {}
    for doc, text in docs:
        w = words(text)
        for item, said in items:
            b = words(said)
            masks = D.MASKS if len(b) >= D.SPAN else ("1" * len(b),)
            for m in masks if b else ():
                kept = [k for k, c in enumerate(m) if c == "1"]
                for p in range(len(w) - len(m) + 1):
                    for q in range(len(b) - len(m) + 1):
                        if all(w[p + k] == b[q + k] for k in kept):
                            for lo in range(min(D.MARGIN, p, q) + 1):
                                for hi in range(len(m), min(len(m) + D.MARGIN, len(w) - p, len(b) - q) + 1):
                                    same = sum(w[p + k] == b[q + k] for k in range(-lo, hi))
                                    if lo + hi >= min(D.LEAST_OVERLAP, len(b)) and same >= D.LEAST_SHARE * (lo + hi):
                                        found[doc, item] = max(found.get((doc, item), (0, 0)), (same, lo + hi))
    return {(d, i, *v) for (d, i), v in found.items()}


def tables(seed=5):
    rng = random.Random(seed)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([3, 11, 12, 15, 30, 50])))) for k in range(14)] + [(90, None), (91, ""), (None, " ".join(say(20))), (0, items_text := " ".join(say(18))), (0, items_text)]
    docs = [(k, " ".join(say(rng.randint(0, 60)))) for k in range(25)]
    for k in range(25, 60):
        _, text = rng.choice([i for i in items if i[1]])
        part = text.split()
        if k % 3:
            for j in range(len(part)):
                if rng.random() < 0.12:
                    part[j] = rng.choice(WORDS)
        sep = rng.choice([" ", ", ", "\n"])
        docs.append((k, " ".join(say(rng.randint(0, 9))) + sep + sep.join(w.title() if k % 2 else w for w in part) + "." + " ".join(say(rng.randint(0, 9)))))
    return docs + [(70, None), (71, ""), (72, "é"), (None, items[3][1]), (30, docs[30][1]), (74, " ".join(say(20_000)) + " " + items[5][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, item string, words int"), spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force_and_both_ways(spark, monkeypatch):
    docs, items = tables()
    d, b = frames(spark, docs, items)
    got = {(r.id, r.item, r.matched, r.overlap) for r in D.contaminated(d, b).collect()}
    small = [x for x in docs if x[0] != 74]
    assert {g for g in got if g[0] != 74} == brute(small, items) and any(g[0] == 74 for g in got)
    assert any(m < n for *_, m, n in got)  # substitutions are tolerated
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert {(r.id, r.item, r.matched, r.overlap) for r in D.contaminated(d, b).collect()} == got
    kept = D.drop_contaminated(d, b)
    bad = {g[0] for g in got}
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in docs if k not in bad)


def test_empty_tables(spark):
    docs, items = tables()
    d, b = frames(spark, docs, items)
    assert D.contaminated(d.limit(0), b).count() == 0 == D.contaminated(d, b.limit(0)).count()
    assert D.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = queries.op5_decontaminate(spark, d)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(queries.oracle_sql()["op5_decontaminate"]).fetchall()) != []


def test_passages_from_the_middle_of_an_item(spark):
    """Exact passages of 13 tokens and more are found wherever they stand in an item and a document."""
    rng = random.Random(11)
    say = lambda n: [rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n)]
    items = [(k, say(40)) for k in range(6)]
    docs = [(100 * k + n, " ".join(say(20) + words[14 : 14 + n] + say(20))) for k, words in items for n in (12, 13, 14, 15, 16, 20)]
    d, b = frames(spark, docs, [(k, " ".join(w)) for k, w in items])
    assert {r.id for r in D.contaminated(d, b).collect()} >= {i for i, _ in docs if i % 100 > 12}
