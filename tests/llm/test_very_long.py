"""Texts of megabytes, long turns and long conversations: what comes back is that of the whole, in seconds."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.exact import shingle_set
from tests.llm.test_brute_force import simple_hash
from terrane.llm import chat, chatrepair, decontaminate, filteraudit, langid, linededup, mixing, nearcopies, qualityrules, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DRAW = random.Random(12)
VOCABULARY = ["".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randint(2, 9))) for _ in range(4000)]
#: 150,000 words, a line break after some; and the same with a few words changed near its end.
WORDS = [DRAW.choice(VOCABULARY) for _ in range(150_000)]
LONG = "".join(w + ("\n" if k % 11 == 10 else " ") for k, w in enumerate(WORDS))
EDITED = "".join(w + ("\n" if k % 11 == 10 else " ") for k, w in enumerate([*WORDS[:-50], *[f"x{k}" for k in range(50)]]))
SHORT = "a line that other documents hold as well, word for word"
ROWS = [(1, LONG, "en", "s"), (2, EDITED, "en", "s"), (3, "short text of a few words", "fr", "t"), (4, LONG[::-1], "en", "s"), *[(k, f"{SHORT}\n{k}", "fr", "t") for k in range(10, 16)], (20, f"{LONG}\n{SHORT}", "en", "t")]
TEXTS = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(autouse=True)
def seconds():
    began = time.time()
    yield
    assert time.time() - began < 90


def test_languages(docs):
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[1] == got[2] == "en"


def test_lines(docs):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[20].n_lines == TEXTS[20].count("\n") + 1 and got[20].n_dropped < got[20].n_lines
    assert SHORT in got[20].kept_text and got[10].kept_text == "10"  # the largest id keeps the line
    assert got[4].kept_text == TEXTS[4]


def test_mixing(docs):
    got = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert got == {i: len(WORD.findall(t)) for i, t in TEXTS.items()}


def test_statistics(docs):
    got = {r.doc_id: r for r in qualityrules.apply_rules(docs, []).collect()}
    lines, seen, twice = TEXTS[1].split("\n"), set(), 0
    for x in lines:
        twice += bool(WORD.search(x)) and x in seen
        seen.add(x)
    assert (got[1].n_words, got[1].word_chars, got[1].n_dup_lines) == (150_000, sum(map(len, WORDS)), twice)


def test_fingerprints_and_near_copies(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[1].fp % (1 << 64) == simple_hash(LONG, 4) and got[1].component_id == got[2].component_id == 1
    near = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    a, b = shingle_set(LONG), shingle_set(EDITED)
    assert len(a & b) / len(a | b) >= 0.8 and near[2] == 1 and near[20] == 1 and near[4] == 4 and near[3] == 3


def test_benchmark_items_at_the_end(spark, docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[-30:])), (2, " ".join(f"x{k}" for k in range(20, 50))), (3, "nowhere to be found in any of them")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (20, 1), (2, 2)}


def test_audit(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = filteraudit.flag_documents(docs, labels).where("good").collect()
    assert [(r.A, r.B, r.C, r.D, r.E) for r in rows] == [(False, 100 * len(set(WORDS)) < 65 * len(WORDS), False, False, False)]


def test_turns_and_conversations(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "#" * 500_000 + LONG + ".")] + [(2, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(50_000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chats)).collect()}
    whole = {c: "".join(f"{r}\n{t}\n" for i, _, r, t in rows if i == c) for c in (1, 2)}
    assert {c: r.turns_sha256 for c, r in got.items()} == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in whole.items()}
    assert got[1].loss_chars == len(LONG) + 500_001 and got[2].n_turns == 50_000 and got[2].valid
    fixed = {r.conv_id: r for r in chatrepair.repair(chats.withColumn("copy", F.lit(0))).collect()}
    assert fixed[2].audit == "K" * 50_000 and fixed[1].truncated == 1 and fixed[1].cost == 4 and fixed[1].audit == "DD"


def test_stages_hand_on_whole_texts(spark, docs, tmp_path):
    spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nowhere to be found in any of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = {r.doc_id: r.text for r in stage(spark, docs, str(tmp_path)).collect()}
    assert kept["quality_rules"][2] == EDITED and kept["decontamination"] == TEXTS
    assert kept["line_dedup"][20] == TEXTS[20] and kept["line_dedup"][11] == "11"
    assert set(kept["near_dedup"]) >= {1, 3, 4} and not {2, 20} & set(kept["near_dedup"]) and kept["near_dedup"][1] == LONG
