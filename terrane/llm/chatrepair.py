"""Repair of conversations whose turns are lost, empty, repeated, cut off or out of order, at the least cost.

A Viterbi pass over the rows of a conversation keeps, for each of four states of the grammar ``(s?(ua)+)?``, the cheapest
way there: its cost, its audit string and the digest of what it would write. Rows stream in order; nothing of a
conversation is held but these four ways.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrane.functions.columns import SPACES

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; what may follow each, and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
PAIRS = {"su", "ua", "au"}

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


class Way:
    """A cheapest way to a state: cost, audit since the prefix that all ways share, digest of its rows, and whether it has any."""

    __slots__ = ("cost", "audit", "digest", "any")

    def __init__(self, cost: int, audit: str, digest, some: bool):
        self.cost, self.audit, self.digest, self.any = cost, audit, digest, some

    def key(self) -> tuple[int, str]:
        return self.cost, self.audit


class Repair:
    """The pass over one conversation: :meth:`add` for each row, then :meth:`result`.

    Two ways of one cost are never prefixes of each other (all but insertions answer one row each, and insertions cost),
    so the lesser audit stays the lesser whatever follows, and one way a state is enough.
    """

    def __init__(self) -> None:
        self.head: list[str] = []
        self.layer: dict[int, Way] = {START: Way(0, "", hashlib.sha256(), False)}
        self._close()

    def _step(self, later: dict[int, tuple], state: int, way: Way, cost: int, letter: str, row: str | None) -> None:
        found = (way.cost + cost, way.audit + letter, way, row)
        if state not in later or found[:2] < later[state][:2]:
            later[state] = found

    @staticmethod
    def _built(later: dict[int, tuple]) -> dict[int, Way]:
        out = {}
        for state, (cost, audit, way, row) in later.items():
            digest = way.digest
            if row is not None:
                digest = digest.copy()
                digest.update((("\n" if way.any else "") + row).encode("utf-8", "surrogatepass"))
            out[state] = Way(cost, audit, digest, way.any or row is not None)
        return out

    def _close(self) -> None:
        """Insertions after a row. Two rounds do: a third would come back to a state that costs less."""
        for _ in range(2):
            later = {s: (w.cost, w.audit, w, None) for s, w in self.layer.items()}
            for state, way in self.layer.items():
                for initial, to in MOVES[state].items():
                    if initial in NAMES:
                        self._step(later, to, way, INSERT, "I", NAMES[initial] + ":")
            self.layer = self._built(later)

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        later: dict[int, tuple] = {}
        for state, way in self.layer.items():
            self._step(later, state, way, DELETE, "D", None)
            if not must_go:
                for initial, to in MOVES[state].items():
                    if initial == role[:1]:
                        self._step(later, to, way, KEEP + TRUNCATED * truncated, "K", f"{role}:{text}")
                    if initial in NAMES:
                        self._step(later, to, way, REROLE + TRUNCATED * truncated, "R", f"{NAMES[initial]}:{text}")
        self.layer = self._built(later)
        self._close()
        self._prune()

    def _prune(self) -> None:
        """Drop ways that can never be the cheapest again, and move what all audits begin with to the head.

        Whatever follows the start but a kept system row can also follow an assistant, and that row can be deleted there.
        """
        best = self.layer[ASSISTANT].cost
        for state, margin in ((START, DELETE), (SYSTEM, 0)):
            if state in self.layer and self.layer[state].cost > best + margin:
                del self.layer[state]
        if len(self.layer[ASSISTANT].audit) >= 64:
            shared = os.path.commonprefix([w.audit for w in self.layer.values()])
            self.head.append(shared)
            for way in self.layer.values():
                way.audit = way.audit[len(shared) :]

    def result(self) -> tuple[int, str, str]:
        way = min((self.layer[s] for s in FINAL if s in self.layer), key=Way.key)
        return way.cost, "".join(self.head) + way.audit, way.digest.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copy``: rows damaged by ``crc32('conv_id:turn') % 20``.

    0 drops a row (``copy`` null: the conversation stays known), 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 sets role user. Nulls read as one space: in the hashed key, as a role and as a text. Whole texts stay, however long.
    """
    one = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), one).alias("role"),
        F.coalesce(F.col("text").cast("string"), one).alias("text"),
    )
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), one), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # A dropped row keeps neither role nor text: it stands for its conversation only.
    gone = kind == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), F.explode(copies).alias("copy")
    )


def repair(rows: DataFrame) -> DataFrame:
    """One row for every conversation of ``rows``: faults found, the cheapest edits and the digest of what they leave.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``copy`` (null: the row only says that the conversation exists).
    Rows go by turn, nulls first, then role, text and copy, so that ties and repeated rows have one order; rows without id are one
    conversation. ``gaps`` ignores null turns. A row's first fault counts: blank, duplicate (role and text seen before in
    the conversation), truncated. Empty tables give no rows; a conversation without rows has zeros and the digest of nothing.

    One exchange by conversation; duplicates are found by a window that reuses it, and both sorts spill. A conversation, however
    long, streams through one task, which holds four ways. Its audit is held as text: it grows by one letter a row, and
    only while no audit letter is settled (a long run of rows of unknown roles) are those strings copied at each row.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = rows.select(
        "conv_id",
        F.col("turn").alias("turn"),
        "role",
        "text",
        "copy",
        F.md5(F.col("text").cast("binary")).alias("digest"),
    ).repartition(parts, "conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    trimmed = F.btrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", "b").when(F.row_number().over(seen) > 1, "d").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "t")
    flagged = here.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))
    ordered = flagged.sortWithinPartitions("conv_id", F.col("copy").isNotNull(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "d", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[tuple] = []

        def close() -> None:
            if now is not None:
                gaps = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["turns"]
                done.append((now["id"], gaps, now["b"], now["d"], now["t"], now["illegal"], *now["repair"].result()))

        for batch in batches:
            for conv, turn, role, text, copy, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "first": None, "last": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "role": None, "repair": Repair()}
                if copy is None:
                    continue
                if turn is not None and turn != now["last"]:
                    now["first"] = turn if now["first"] is None else now["first"]
                    now["last"] = turn
                    now["turns"] += 1
                if fault:
                    now[fault] += 1
                now["illegal"] += now["role"] is not None and now["role"] + role[:1] not in PAIRS
                now["role"] = role[:1]
                now["repair"].add(role, text, fault in ("b", "d"), fault == "t")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS)], names=[f.split()[0] for f in RESULT.split(", ")])
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS)], names=[f.split()[0] for f in RESULT.split(", ")])

    return ordered.mapInArrow(run, RESULT)
