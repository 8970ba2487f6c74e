"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE``.  A rendered turn is read back by a deterministic parser and compared
with its source; where they differ, the turn is rendered again with its conflicting content escaped, and must then be identical.
Escaping puts one more backslash between ``<`` and ``|`` wherever only backslashes stand between them, so it is reversible at any
depth and no control string is left in a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import small_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LINE = "<|nl|>"  # a line break inside a role; can't come from an escaped role
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns of a rendered text as (role, text, start, end of the text as rendered); None if it isn't of the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find("<|", line + 1)
        if line < 0 or end < 0 or not rendered.startswith(CLOSE, end):  # no control string but the closing one may follow a text
            return None
        role = rendered[at + len(OPEN) : line].replace(LINE, "\n")
        if "<|" in role:
            return None
        turns.append((unescape(role), unescape(rendered[line + 1 : end]), line + 1, end))
        at = end + len(CLOSE)
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only if it doesn't come back the same as it is."""
    out = f"{OPEN}{role}\n{text}{CLOSE}"
    back = parse(out)
    if back is None or len(back) != 1 or back[0][:2] != (role, text):
        out = f"{OPEN}{escape(role).replace(chr(10), LINE)}\n{escape(text)}{CLOSE}"
        back = parse(out)
        if back is None or len(back) != 1 or back[0][:2] != (role, text):
            raise ValueError("a rendered turn doesn't come back as its source")
    return out


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered turns: conv_id, turn, role, rendered, mask_start, mask_end (of the loss mask inside ``rendered``; null: none).

    A conversation's rendered text is its turns' ``rendered`` in row order.  Rows go by turn; equal turns by role, then text, null
    first; repeated rows stay.  Null text and null role count as empty; rows with a null conv_id form one conversation of their own.
    Other columns are left out.  One shuffle by conv_id; each conversation streams through a sorted partition.
    """
    small_batches(conversations.sparkSession, 2048)
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [render(r, t) for r, t in zip(b["role"], b["text"], strict=True)]
            spans = [parse(x)[0][2:] if r == loss_role else (None, None) for x, r in zip(out, b["role"], strict=True)]
            b = b.drop(columns="text")
            b["rendered"] = out
            b["mask_start"] = pd.array([s for s, _ in spans], dtype="Int64")
            b["mask_end"] = pd.array([e for _, e in spans], dtype="Int64")
            yield b

    return rows.mapInPandas(run, f"conv_id {types['conv_id']}, turn {types['turn']}, role string, rendered string, mask_start long, mask_end long")


class _Reader:
    """Reads one conversation back from its rendered turns."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, rendered: str, start, end) -> None:
        self.formatted_chars += len(rendered)
        for role, text, _, _ in parse(rendered) or ():
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if not pd.isna(start):
            learned = unescape(rendered[int(start) : int(end)])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def result(self, conv_id) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from the rendered turns of ``format_chat`` as they lie in its partitions."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reader = object(), None
        for b in batches:
            done = []
            for conv, rendered, start, end in zip(b["conv_id"], b["rendered"], b["mask_start"], b["mask_end"], strict=True):
                conv = None if pd.isna(conv) else conv
                if reader is None or conv != current:
                    if reader is not None:
                        done.append(reader.result(current))
                    current, reader = conv, _Reader()
                reader.add(rendered, start, end)
            yield _frame(done, names)
        if reader is not None:
            yield _frame([reader.result(current)], names)

    return formatted.select("conv_id", "rendered", "mask_start", "mask_end").mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="object" if n.endswith("sha256") else "Int64") for i, n in enumerate(names)})
