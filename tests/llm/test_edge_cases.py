"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: every operator and stage has a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import chat, decontaminate, htmltext, langid, licensescan, linededup, mixing, nearcopies, qualityrules, secretscan, simhash

#: Names that operators use within.
CLASHES = (
    "h1 h2 pos line key fp rep bucket u rank a b node component component_id raw words quality taken target size part whole offset before start "
    "kept rule base_failed dropped text_hash n_lines keep_bitmap kept_text pattern mask hits positions lang_pred score matches spans stay keeper"
).split()
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, None, "en", "s1"),
    (2, "", "en", "s1"),
    (3, " \t\n ", None, None),
    (4, "one", "fr", "s1"),
    (5, LONG, "en", "s2"),
    (5, LONG, "en", "s2"),
    (None, "some words without any id at all here", "en", "s1"),
    (7, "same text " * 30, "en", None),
    (8, "same text " * 30, "en", None),
    (8, "another text of the same id " * 20, "de", "s3"),
    (9, "é" * 50 + "\n" + "%%% ### !!!", "de", "s3"),
    (10, "\x00\ud7ff\U0001f600 odd characters\r\nand lines\x0bhere", "es", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "ipsum dolor sit amet lorem ipsum"), (3, "ipsum dolor sit amet lorem ipsum"), (4, "one"), (None, "odd characters")], "item_id long, text string")


def ops(labels, benchmark):
    return {
        "op1": lambda d: licensescan.scan_licenses(d),
        "op2": lambda d: langid.identify(d, langid.train(d)),
        "op3": lambda d: secretscan.scan_secrets(d),
        "op4": lambda d: linededup.dedup_lines(d),
        "op5": lambda d: mixing.mix(d),
        "op9": lambda d: qualityrules.apply_rules(d, qualityrules.train(d, labels)),
        "op10": lambda d: simhash.near_duplicates(d),
        "near": lambda d: nearcopies.near_copies(d),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op9", "op10", "near"])
def test_every_row_comes_back_once(docs, labels, benchmark, name):
    op = ops(labels, benchmark)[name]
    ids = sorted((r.doc_id for r in op(docs).collect()), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)
    assert op(docs.limit(0)).collect() == []


def test_null_and_blank_texts(docs, labels):
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert lang[1] == lang[2] == lang[3] == ("und", 0.0)
    fp = {r.doc_id: r.fp for r in simhash.near_duplicates(docs).collect()}
    assert fp[1] == fp[2] == fp[3] == 0
    q = {r.doc_id: r for r in qualityrules.apply_rules(docs, []).collect()}
    assert q[1].base_failed and (q[3].n_words, q[3].word_chars) == (0, 0)
    lines = {r.doc_id: (r.n_lines, r.kept_text) for r in linededup.dedup_lines(docs).collect()}
    assert lines[1] == lines[2] == (1, "")
    mixed = {r.doc_id: (r.size, r.taken, list(r.positions)) for r in mixing.mix(docs).collect()}
    assert mixed[1] == (0, 0, [])


def test_components_of_repeats(docs):
    got = simhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]
    assert {r.component_id for r in got if r.doc_id == 7} == {7}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_decontamination(docs, benchmark):
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 3), (4, 4), (10, None)}
    assert decontaminate.contaminated(docs.limit(0), benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []


def test_decontamination_with_a_full_filter_is_the_same(docs, benchmark, monkeypatch):
    one = {tuple(r) for r in decontaminate.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "hash_map", lambda entries, n: np.full(1024, ~np.uint64(0)))
    assert {tuple(r) for r in decontaminate.contaminated(docs, benchmark).collect()} == one


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "no markup at all"), (4, "u", "<<>>&#0;&bogus; <p>a</b></p>"), (None, "u", "<article><p>" + "word " * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"))
    got = htmltext.extract(pages, htmltext.train(), keep=["url"]).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows]
    assert [r.text for r in got[:3]] == ["", "", ""] and got[5].text == ("word " * 9).strip()
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(pages.limit(0), htmltext.Field()).collect() == []


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (2, None, None, "y"), (None, 0, "user", "z"), (None, 0, "user", "z"), (3, 0, "tool: a", "#<\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("seg"), F.lit(1).alias("state"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, 2: 1, None: 2, 3: 1}
    assert got[1].valid and got[1].loss_chars == 1 and not got[2].valid and got[None].violation == "user -> user"
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


def test_stages(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
