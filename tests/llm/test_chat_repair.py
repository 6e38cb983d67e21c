"""Operator 13 against its SQL, against all edit sequences, and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from terrane.llm import chatrepair, queries
from tests.test_oracle import compare

BLANK = re.compile(r"[\x20\x09-\x0D]*")
GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
INSERTS = ["", "u", "a", "ua", "au"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit of every row with every insertion around it."""
    marks, best = faults(rows), None
    names = {"u": "user", "a": "assistant"}
    for edits in product(*[["D"] if m in ("b", "d") else ["D", "K", "Ru", "Ra"] for m in marks]):
        for extra in product(INSERTS, repeat=len(rows) + 1):
            cost, audit, told = 5 * len(extra[0]), "I" * len(extra[0]), [names[x] + ":" for x in extra[0]]
            for (role, text), mark, edit, more in zip(rows, marks, edits, extra[1:]):
                cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + 5 * (mark == "t" and edit != "D") + 5 * len(more)
                audit += edit[0] + "I" * len(more)
                told += [f"{role if edit == 'K' else names[edit[1]]}:{text}"] if edit != "D" else []
                told += [names[x] + ":" for x in more]
            if GRAMMAR.fullmatch("".join(x[:1] for x in told)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(told)
    return best


def by_pass(rows):
    walk = chatrepair.Repair()
    for (role, text), mark in zip(rows, faults(rows)):
        walk.add(role, text, mark in ("b", "d"), mark == "t")
    return walk.result()


def test_against_sql(spark, sf):
    compare(spark, sf, queries.op13_chat_repair, queries.oracle_sql()["op13_chat_repair"])


@pytest.mark.parametrize("seed", range(40))
def test_a_pass_against_all_edits(seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["user", "assistant", "system", "tool", "", "user"]), draw.choice(["Yes.", "No!", "cut", "", "\n"])) for _ in range(draw.randint(0, 3))]
    cost, audit, text = cheapest(rows)
    assert by_pass(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_longer_passes_against_a_plain_search():
    """Without pruning and shared heads: strings by state, closed until nothing changes."""
    draw = random.Random(5)
    for _ in range(60):
        rows = [(draw.choice(["user", "assistant", "assistant", "system", "tool"]), f"{k}{draw.choice(['.', '', '!'])}") for k in range(draw.randint(60, 200))]
        layer = {"0": (0, "")}

        def close(layer):
            while True:
                more = dict(layer)
                for s, (c, a) in layer.items():
                    for to, ok in (("u", s in "0sa"), ("a", s == "u")):
                        if ok and (c + 5, a + "I") < more.get(to, (10**9, "")):
                            more[to] = (c + 5, a + "I")
                if more == layer:
                    return layer
                layer = more

        layer = close(layer)
        for (role, _), mark in zip(rows, faults(rows)):
            cut = 5 * (mark == "t")
            now = {}
            for s, (c, a) in layer.items():
                ways = [(s, c + 2, "D")]
                for to in {"0": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    ways += [(to, c + cut, "K")] if role[0] == to else []
                    ways += [(to, c + 1 + cut, "R")] if to != "s" else []
                for to, cost, letter in ways:
                    now[to] = min(now.get(to, (10**9, "")), (cost, a + letter))
            layer = close(now)
        assert by_pass(rows)[:2] == min(layer[s] for s in "0a" if s in layer)


def test_damage_by_key(spark):
    rows = [(c, t, "assistant", f"a. b! {t}?") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = sorted((tuple(r) for r in chatrepair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            want.append((c, None, None, None, None))
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, k) for k in range(1 + (kind == 3))]
    assert got == sorted(want, key=repr) and {len(r) for r in got} == {5} and any(r[4] is None for r in got) and any(r[4] == 1 for r in got)


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", copy int")
    df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate("fault digest trimmed gaps cost audit".split())])
    return {r.conv_id: r for r in chatrepair.repair(df).collect()}


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."),
        (2, None, "user", "First."), (2, 7, "assistant", "Second."), (2, 3, "assistant", "Second."),
        (None, 0, "user", "No id."), (None, 0, "user", "No id."), (None, 1, "assistant", "cut"),
        (4, None, "tool", " \t "), (4, None, "", "x."),
        (5, 0, "system", "Be kind."),
        (6, 0, "user", "é　"), (6, 1, "assistant", "\U0001f600."), (6, 1, "assistant", "\U0001f600."),
    ]
    got = repaired(spark, rows)
    assert set(got) == {1, 2, None, 4, 5, 6}
    assert tuple(got[1])[1:8] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[1].repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest()
    assert (got[2].gaps, got[2].duplicate, got[2].illegal, got[2].audit) == (3, 1, 1, "KKD")
    # Deleting the cut row and the other costs 4 with its duplicate 2; keeping it 5 more.
    assert (got[None].duplicate, got[None].truncated, got[None].illegal) == (1, 1, 1)
    assert (got[4].gaps, got[4].blank, got[4].illegal, got[4].audit) == (0, 1, 1, "DD")
    assert got[4].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[5].cost, got[5].audit) == (2, "D")
    assert (got[6].truncated, got[6].duplicate) == (1, 1)
    for conv in (1, 2, None, 4, 5):
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert (got[conv].cost, got[conv].audit) == cheapest([r[1:] for r in mine])[:2]


def test_dropped_conversations_and_empty_tables(spark):
    gone = spark.createDataFrame([(9, None, None, None, None)], SCHEMA + ", copy int")
    row = chatrepair.repair(gone).collect()[0]
    assert tuple(row)[:8] == (9, 0, 0, 0, 0, 0, 0, "") and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert chatrepair.repair(chatrepair.damage(gone.limit(0))).collect() == []


def test_a_long_conversation_and_a_long_turn(spark):
    rows = [(1, t, "tool" if t < 20_000 else "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(30_000)]
    rows += [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "Yes.")]
    began = time.time()
    got = repaired(spark, rows)
    assert got[1].cost == 20_000 and got[1].audit == "R" * 20_000 + "K" * 10_000
    assert got[2].audit == "KK" and time.time() - began < 60


def test_one_exchange(spark, sf):
    plan = queries.op13_chat_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("ReusedExchange ") == 1
