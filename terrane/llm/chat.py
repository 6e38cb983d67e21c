"""Chat formatting: a finite-state machine over roles and a declarative template, with loss flags by segment.

Turns stream through sorted partitions, a conversation in one of them, and leave as text segments; nothing of a
conversation is held but its state, so its length does not matter to memory. Reading back is the same kind of stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """How a turn looks, and which roles are trained on.

    ``head`` has the escaped role for {role}; ``end`` closes a turn. ``codes`` maps every character with which control
    strings begin, and ``escape`` itself, to the letter that stands for it after ``escape``; as those characters never
    occur in an escaped text, no text can hold a control string, and decoding is exact.
    """

    head: str = "### {role}: "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    codes: tuple[tuple[str, str], ...] = (("\\", "\\"), ("#", "h"), ("<", "l"))
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    #: The machine: state and role give the next state; what is missing is a violation, after which the role's own state holds.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    final: tuple[str, ...] = ("assistant",)

    def encode(self, text: str) -> str:
        return text.translate({ord(c): self.escape + code for c, code in self.codes})

    def decode(self, text: str) -> str:
        back = {code: c for c, code in self.codes}
        return re.sub(re.escape(self.escape) + "(.)", lambda m: back[m[1]], text, flags=re.S)

    def shown(self, role: str) -> str:
        """A known role by its name; any other escaped, with a colon coded too, after a mark that no name has."""
        known = dict(self.names)
        return known[role] if role in known else "=" + self.encode(role).replace(":", self.escape + "c")

    def role(self, shown: str) -> str:
        if not shown.startswith("="):
            return {name: role for role, name in self.names}[shown]
        return self.decode_role(shown[1:])

    def decode_role(self, text: str) -> str:
        back = {code: c for c, code in self.codes} | {"c": ":"}
        return re.sub(re.escape(self.escape) + "(.)", lambda m: back[m[1]], text, flags=re.S)


SEGMENTS = "conv_id long, turn long, seg int, text string, loss boolean, state string, violation string"


def format_chats(
    conversations: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Three segments for every turn, in order within a partition: head, body, end; ``loss`` is set on trained bodies.

    ``state`` is the machine's after the turn, ``violation`` says which move was not allowed, else null. Conversations
    that break the order are formatted all the same. Rows are ordered by turn (null first), then role and text, so that
    ties and repeated rows have one order; very long turns are whole segments, and conversations of any length stream; null roles and texts count as empty; rows with a null id are a conversation;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    form = template or Template()
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = {(s, r): t for s, r, t in form.moves}
        now: tuple[bool, int | None] = (False, None)
        state = "start"
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (True, conv):
                    now, state = (True, conv), "start"
                later = moves.get((state, role))
                wrong = None if later else f"{state} -> {role}"
                state = later or (role if any(role == t for *_, t in form.moves) else state)
                trained = role in form.loss_roles
                for seg, part in enumerate((form.head.format(role=form.shown(role)), form.encode(text), form.end)):
                    for column, value in zip(out, (conv, turn, seg, part, trained and seg == 1, state, wrong)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    return ordered.mapInArrow(run, SEGMENTS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, violation string"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for every conversation of ``segments`` as :func:`format_chats` returns them: digests of what the text itself says.

    Turns are parsed from the formatted text, and the loss text is what the flags mark; both are decoded before they
    are hashed. Segments must come in order, which a narrow chain of both functions keeps. ``valid``: no move was
    against the machine and the last state is a final one.
    """
    form = template or Template()
    head = re.compile(re.escape(form.head).replace(re.escape("{role}"), "([^:]*)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
        names = [f.split()[0] for f in READ.split(", ")]
        done: list[tuple] = []
        now: dict | None = None

        def close() -> None:
            if now is not None:
                if now["open"]:
                    raise ValueError("formatted text ends within a turn")
                ok = now["wrong"] is None and now["state"] in form.final
                done.append((now["id"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["length"], ok, now["wrong"]))

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6))
            for conv, text, loss, state, wrong in zip(*columns):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "turns": 0, "chars": 0, "length": 0, "open": "", "state": "start", "wrong": None}
                    now |= {"all": hashlib.sha256(), "loss": hashlib.sha256()}
                now["length"] += len(text)
                now["state"], now["wrong"] = state, now["wrong"] or wrong
                if loss:
                    plain = form.decode(text)
                    now["chars"] += len(plain)
                    now["loss"].update(plain.encode("utf-8", "surrogatepass"))
                now["open"] += text
                if now["open"].endswith(form.end):
                    m = head.match(now["open"])
                    if m is None:
                        raise ValueError("formatted text has a turn without a head")
                    body = form.decode(now["open"][m.end() : -len(form.end)])
                    now["all"].update(f"{form.role(m[1])}\n{body}\n".encode("utf-8", "surrogatepass"))
                    now["turns"] += 1
                    now["open"] = ""
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return segments.mapInArrow(run, READ)
