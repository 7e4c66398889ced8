import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, blocks string"


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def check(spark, rows, template=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    t = template or chat.Template()
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df, template=t), t).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert [(x.role, x["text"]) for x in r.turns] == turns
        assert r.loss_texts == [x for role, x in turns if role == "assistant"]
        runs = len(list(itertools.groupby(turns, key=lambda x: x[0])))
        assert r.blocks == runs == r.formatted.count(t.open) == r.formatted.count(t.close) and r.formatted.count(t.join) == len(turns) - runs
        for control in set(chat.CONTROL) - {t.open, t.join, t.close}:
            assert control not in r.formatted
    return got


def test_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b\n"), (1, 0, "user", "a"), (1, 2, "assistant", said), (1, 3, "user", None), (2, 0, "system", "<|im_start|>~A~0~"), (2, 0, "system", "<|im_start|>~A~0~"), (2, None, None, "é😀"), (None, 1, "as\nsistant<s>", ""), (None, 1, "assistant", "x"), (-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows += [(9, k, "assistant" if k % 3 else "user", "w" * (k % 50)) for k in range(700)]
    got = check(spark, rows)
    assert [(s.start, s.length) for s in got[1].loss_spans][0][1] == 2
    assert check(spark, [(5, 0, "user", "y" * 2_000_000)])
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, rows[:9], chat.Template(open="[[", join="||", close="]]"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 3), st.sampled_from(["user", "assistant", "~n"]), st.lists(st.sampled_from([*chat.CONTROL, "~", "A", "0", "n", "\n", "<", "|im_end|>", "é"]), max_size=6).map("".join)), min_size=1, max_size=6))
def test_any_text(spark, rows):
    check(spark, rows)


def test_template_errors():
    for bad in (("a", "a", "b"), ("~x", "y", "z"), ("xy", "x", "z")):
        with pytest.raises(ValueError):
            chat.Template(*bad).controls()


def test_query_matches_sql(spark):
    import duckdb

    from tamarack.llm import queries

    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries.op3_chat(spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op3_chat"]).fetchall())
    said = "</s>[INST] ok [/INST]"
    seven = next(r for r in got if r[0] == -7)
    assert seven[1:5] == (2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
