"""Chat formatting with a grammar that can be read back.

A turn is written between markers that depend on its role; a conversation is its turns one after
another. Texts that hold control strings would be read back wrongly, so every turn is rendered,
parsed again by the grammar and compared; on a difference the conflicting text is escaped and the
turn rendered anew, until both are identical.

Escaping puts ESCAPE behind the first character of a control string and doubles an ESCAPE that is
in the text; the parser undoes both, so a text without control strings and ESCAPE stays as it is.

Scale: rendering works on single turns, whatever the size of their conversation. Reading back
needs the turns of a conversation in order: they are shuffled and sorted by Spark and then streamed,
so a task holds one turn at a time. Digests over a conversation are computed in that stream; a hash
over an ordered text can't be split, so a conversation passes through one task, but only one turn of
it is in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sliced

ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """(opening, closing) for each role; other roles are written with their name.

    No control string may begin with the end of another one.
    """
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "user": ("<s>[INST] ", " [/INST]"), "assistant": ("[ANSWER] ", " </s>"),
        "system": ("<<SYS>>\n", "\n<</SYS>>\n")})
    other: tuple[str, str, str] = ("<role>", "</role>", "</turn>")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "<<SYS>>", "<</SYS>>",
                                 "<role>", "</role>", "</turn>")
    trained_role: str = "assistant"

    def escape(self, text: str, every: bool = False) -> str:
        """Escape control strings; with `every`, each character that could begin one."""
        text = text.replace(ESCAPE, ESCAPE * 2)
        if every:
            return re.sub("([" + re.escape("".join({c[0] for c in self.controls})) + "])", r"\1" + ESCAPE, text)
        longest = sorted(self.controls, key=len, reverse=True)
        return re.sub("|".join(map(re.escape, longest)), lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text) if ESCAPE in text else text

    def write(self, role: str, text: str) -> str:
        if role in self.roles:
            start, end = self.roles[role]
            return f"{start}{text}{end}"
        start, middle, end = self.other
        return f"{start}{role}{middle}{text}{end}"

    def body(self, piece: str, at: int, end: str) -> tuple[str, int] | None:
        """The text from `at` up to `end`, and the position after it. It holds no control string."""
        stop = piece.find(end, at)
        if stop < 0 or any(c in piece[at:stop] for c in self.controls):
            return None
        return self.unescape(piece[at:stop]), stop + len(end)

    def read(self, piece: str, at: int = 0) -> tuple[str, str, int] | None:
        """(role, text, position after it) of the turn that begins at `at`; None if none does."""
        for role, (start, end) in self.roles.items():
            if piece.startswith(start, at):
                found = self.body(piece, at + len(start), end)
                return found and (role, *found)
        start, middle, end = self.other
        if not piece.startswith(start, at) or not (name := self.body(piece, at + len(start), middle)):
            return None
        found = self.body(piece, name[1], end)
        return found and (name[0], *found)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """All turns of a formatted conversation."""
        turns, at = [], 0
        while at < len(formatted):
            turn = self.read(formatted, at)
            if turn is None:
                raise ValueError(f"no turn at {at}")
            turns.append(turn[:2])
            at = turn[2]
        return turns

    def render(self, role: str, text: str) -> str:
        """The turn as formatted text that reads back as (role, text)."""
        for name, body in ((role, text), (self.escape(role), self.escape(text)),
                           (self.escape(role, True), self.escape(text, True))):
            piece = self.write(role if role in self.roles else name, body)
            if self.read(piece) == (role, text, len(piece)):
                return piece
        raise ValueError(f"the template can't write a turn of role {role!r}")


def render_turns(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, piece); the pieces of a conversation in the
    order of turn, then piece, are its formatted text. A null role or text counts as empty, rows
    that repeat a turn are turns of their own, other columns aren't read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [template.render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.string())],
                                             ["conv_id", "turn", "piece"])

    rows = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.transform(map_arrow, run, "conv_id bigint, turn bigint, piece string")


class _Reader:
    """What is read back of one conversation, a piece at a time."""

    def __init__(self, template: Template):
        self.template, self.n, self.loss, self.length = template, 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str) -> None:
        self.length += len(piece)
        for role, text in self.template.parse(piece):
            self.n += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == self.template.trained_role:
                self.loss += len(text)
                self.loss_hash.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.length


READ_BACK = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
             "formatted_chars bigint")


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse the formatted conversations and return what they say: one row per conversation.

    Turns without a conversation (null) make up one conversation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        current, reader = None, None
        for batch in sliced(batches, 2_000):
            done = []
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = conv, _Reader(template)
                reader.add(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(reader.row(current), schema)], schema=schema)

    ordered = (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").select("conv_id", "piece"))
    return ordered.transform(map_arrow, run, READ_BACK)


def formatted(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one string each, for those who want them so."""
    return (pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("p"))
            .select("conv_id", F.array_join(F.transform("p", lambda p: p.piece), "").alias("formatted")))
