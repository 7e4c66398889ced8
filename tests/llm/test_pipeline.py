"""The stages on a small corpus whose every document has a known fate."""

import random

from tamarack.llm import near_duplicates
from tamarack.llm import pipeline as P

from .test_line_dedup import brute, crowd


def corpus(tmp_path, spark):
    rng = random.Random(6)
    words = [a + b for a in "bcdfglmnprst" for b in ("an", "el", "io", "ur", "ata", "eno", "ith", "ore")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, fate = [], {}

    def add(text, what, label=None):
        fate[len(rows)] = what
        rows.append((len(rows), text, "en", "src", len(text or ""), label))

    for k in range(150):
        add("\n".join(say(30) for _ in range(3)), "clean", 1)
        if k % 4 == 0:
            add("### ".join(say(90).split()) + "$$$", "junk", 0)
    shared, passage = say(55), say(30)
    texts = [r[1] for r in rows if fate[r[0]] == "clean"]
    for k in range(12):
        add(say(60) + "\n" + shared + "\n" + say(40), "clean with a shared line")
        add(texts[k], "copy")
        near = texts[20 + k].split(" ")
        near[7] = "changed"
        add(" ".join(near).replace("\n", " "), "near copy in one line")
    add(say(70) + "\n" + say(20) + " " + passage + " " + say(20), "leak")
    add(None, "empty")
    add("", "empty")
    add("the same word " * 60, "repeats")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int")
    docs.drop("label").write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("label IS NOT NULL").selectExpr("doc_id", "label AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return fate, {r[0]: r[1] for r in rows}, shared


def test_stages(spark, tmp_path):
    fate, texts, shared = corpus(tmp_path, spark)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert name == "packing" or docs.columns == columns
        seen[name] = docs.collect()
    of = lambda what: {k for k, v in fate.items() if v == what}
    left = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    clean = of("clean") | of("clean with a shared line")
    assert left["quality rules"] == set(fate) - of("junk") - of("empty") - of("repeats")
    lines = {r.doc_id: r for r in seen["line dedup"]}
    assert not of("copy") & set(lines) and clean <= set(lines) and sum(shared in r.text for r in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values()) and all(lines[k].text == texts[k] for k in of("clean"))
    assert clean <= left["near duplicates"] and not of("near copy in one line") & left["near duplicates"]
    assert of("leak") & left["near duplicates"] and left["decontamination"] == left["near duplicates"] - of("leak")
    assert left["packing"] == left["decontamination"] == clean
    again = P.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["packing"])


def test_stages_on_odd_tables(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None), (1, "a b c " * 30, 2), (1, "a b c " * 30, 2)], "doc_id long, text string, kept int").selectExpr("*", "'x' AS n_lines", "1 AS row")
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {name: sorted((r.text for r in stage(spark, odd, str(tmp_path)).collect()), key=str) if name not in ("near duplicates", "decontamination", "packing") else stage(spark, odd, str(tmp_path)).count() for name, stage in P.STAGES}
    same = "a b c " * 30
    # repeats too much; of rows that repeat one keeps its line; one of a class; no benchmark item; each row is packed
    assert kept == {"quality rules": [], "line dedup": [None, same], "near duplicates": 2, "decontamination": 3, "packing": 3}
    assert near_duplicates.SHINGLE == 5


def test_line_stage_loses_no_link_of_a_large_open_group(spark):
    """Lines that share one block with their like only, in a group above the bound for pairs: one document of each couple stays."""
    rows = list(enumerate(crowd(13, 150)))
    kept, _ = brute(rows)
    left = P.lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == {d for v in kept.values() for d, _ in v}
