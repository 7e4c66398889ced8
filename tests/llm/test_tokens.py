import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import packing, token_counts, tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_ids_equal_the_library(slow):
    for text in ["", " a  b", "it's  we'll\n\n  z ", "<|endoftext|> hi", "日本語 テキスト 😀", "x" * 3000, " " * 500 + "a", "  a", "1½²", "a\tb\r\n"]:
        assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == slow(text)


@pytest.mark.parametrize("run", [" ", "\n ", "\u3000", "\t"])
def test_long_runs_of_white_space(slow, monkeypatch, run):
    monkeypatch.setattr(tokens, "RUN", 40)
    monkeypatch.setattr(tokens, "_RUN", tokens.re.compile(f"[{tokens._SPACE}]{{40,}}"))
    made = tokens.encoder(PATH)
    for text in (run * 60, "a" + run * 60 + "b 1", run * 60 + "<|endoftext|>" + run * 60 + "!x", f"it's{run * 90}'s {run * 50}\x1c", "x <|endoftext|>" + run * 70):
        assert np.frombuffer(made.encode(text), "<u4").tolist() == slow(text) and made.count(text) == len(slow(text))


def test_very_long_texts(slow):
    made = tokens.encoder(PATH)
    for text in (" " * 3_000_000, "\n " * 1_500_000 + "end", "a" + "\t" * 1_200_000 + "b", "x" * 3_000_000, "7" * 3_000_000, "-" * 3_000_000):
        assert made.count(text) > 0
    text = "word " + " " * 1_500_000 + "end"
    assert np.frombuffer(made.encode(text), "<u4").tolist() == slow(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_tightest(lengths):
    place, offset, windows = packing.best_fit(lengths, 64)
    open_rooms, expected = [], {}
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in open_rooms if r >= lengths[k]]
        if fits:
            open_rooms.remove(min(fits))
        room = min(fits) if fits else 64
        expected[k] = 64 - room
        open_rooms.append(room - lengths[k])
    assert windows == len(open_rooms) and [expected[k] for k in range(len(lengths))] == offset
    for w in range(windows):
        spans = sorted((offset[k], offset[k] + lengths[k]) for k in range(len(lengths)) if place[k] == w)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 64


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sequence_id string, `offset` int")


def test_pack_round_trip(spark, slow):
    rows = [(1, "alpha beta " * 900), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "no id"), (6, "x" * 50_000)]
    got = packing.pack(docs(spark, rows)).collect()
    for doc, text in rows:
        ids = slow(text) + [0]
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        if doc == 4:
            assert [(r.start, r.length) for r in pieces] == [(0, len(ids))] * 2
            continue
        assert [r.start for r in pieces] == list(range(0, len(ids), 1024)) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


def test_little_padding(spark):
    rows = [(k, "word " * (k * 37 % 700 + 1)) for k in range(3000)]
    got = packing.pack(docs(spark, rows).coalesce(1), together=1000).collect()
    assert sum(r.length for r in got) > 0.985 * 1024 * len({r.sequence_id for r in got})


def test_histogram_answers(spark, slow):
    rows = [(k, "ab cd " * (k * 31 % 97)) for k in range(200)] + [(7, None), (8, ""), (9, "word " * 9000)]
    lens = [len(slow(t)) for _, t in rows]
    table = token_counts.every_limit(docs(spark, rows))
    for r in table.collect():
        n = r.context_limit
        assert (r.docs_at, r.docs_over, r.all_docs, r.all_tokens, r.truncated_total) == (lens.count(n), sum(x > n for x in lens), len(lens), sum(lens), sum(min(x, n) for x in lens))
        assert abs(r.quantile - sum(x <= n for x in lens) / len(lens)) < 1e-12
    limits = [0, 1, 50, 333, 100_000]
    assert {r.limit: r.truncated_total for r in token_counts.truncated_totals(table, limits).collect()} == {n: sum(min(x, n) for x in lens) for n in limits}
    assert token_counts.every_limit(docs(spark, [])).count() == 0


def test_padding_does_not_depend_on_the_division(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for parts in (1, 211):
        got = packing.pack(rows.repartition(parts)).toPandas()
        used = got.groupby("sequence_id").length.sum()
        assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.99
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert (own.offset.to_numpy() == np.r_[0, np.cumsum(own.length.to_numpy())[:-1]]).all()
