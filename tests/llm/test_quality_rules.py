import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dups = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\t\v\x1c\x85é#|", max_size=60))
def test_base_counts(text):
    assert Q.base_counts(text, Q.word_hashes(text)) == brute(text)
    assert Q.word_hashes(text, 5).tolist() == Q.word_hashes(text).tolist()
    whole, parts = np.concatenate([*Q.char_buckets(text), []]), np.concatenate([*Q.char_buckets(text, 7), []])
    assert sorted(whole) == sorted(parts)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = ["and", "the", "river", "stone", "morning", "house", "under", "light", "garden", "walk"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, rng.integers(60, 120)))
        bad = k % 5 == 0
        rows.append((k, text.upper().replace(" ", "!! ") if bad and k % 2 else text.replace(" ", "### ") if bad else text, 0 if bad else 1))
    return rows


def frames(spark, rows, labelled):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if labelled(i)] + [(None, 1), (3, None)], "doc_id long, quality int")
    return docs, labels


def test_learns_and_keeps_clean(spark):
    rows = corpus(1, 400)
    docs, labels = frames(spark, rows, lambda i: i % 3)
    model = Q.train(docs, labels)
    got = {r.doc_id: r for r in Q.apply(docs, model, columns=["doc_id"]).collect()}
    unseen = [(i, y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([got[i].kept == bool(y) for i, y in unseen]) > 0.97
    for i, text, _ in rows[:40]:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
    probabilities = [got[i].probability for i, _ in unseen]
    assert abs(np.mean(probabilities) - np.mean([y for _, y in unseen])) < 0.1
    again = {r.doc_id: r.probability for r in Q.apply(docs.repartition(3), Q.train(docs.repartition(5), labels.repartition(3)), columns=["doc_id"]).collect()}
    assert all(again[i] == r.probability for i, r in got.items())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "w " * 60, "c"), (5, "x" * 3_000_000 + " y" * 60, "d")], "doc_id long, text string, extra string")
    got = Q.apply(docs, None).collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept, r.probability, r.extra) for r in got][:3] == [(1, 0, True, False, None, "a"), (2, 0, True, False, None, "b"), (2, 0, True, False, None, "b")]
    assert got[3].n_repeat_words == 60 and not got[3].kept and got[4].n_words == 61
    assert Q.apply(docs.limit(0), None).count() == 0
    assert Q.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    clash = docs.withColumn("kept", docs.doc_id)
    both = Q.apply(clash, None)
    assert "kept_" in both.columns and both.first().kept == 1 and both.first().kept_ is False
