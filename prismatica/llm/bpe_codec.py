"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary token can come last in its encoding.  An automaton over the vocabulary (with
suffix links) gives the tokens that end at each position; the token whose predecessor, the last token of the prefix before it, is
compatible with it is stored; following these tokens back from the end emits the exact ids.  Pre-tokens are encoded once and
remembered in a bounded memo.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.bpe import merge_table, tokenizer_path
from prismatica.llm.common import small_batches, names_apart

#: Fixed value: the published pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixCodec:
    """Encoder and decoder of one vocabulary; ``limit`` bounds the memo of pre-tokens and the remembered automaton transitions.

    An automaton state is the longest suffix read so far that some token begins with; its matches are the tokens that end here.
    """

    def __init__(self, path: str, limit: int = 150_000):
        import regex

        self.table, self.limit = merge_table(path), limit
        self.memo: dict[str, tuple[int, ...]] = {}
        self.states = {s[:n]: None for s in self.table.ids for n in range(len(s) + 1)}
        self.states = {s: i for i, s in enumerate(self.states)}
        self.names = list(self.states)
        self.matches: list[tuple | None] = [None] * len(self.names)
        self.moves: dict[int, int] = {}
        self.pieces = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.table.specials, key=len, reverse=True)))) if self.table.specials else None
        self.bytes = [s.encode("latin-1") for s in self.table.spelled]
        for content, i in self.table.specials.items():
            self.bytes[i] = content.encode()

    def _move(self, key: int) -> int:
        """The state after one more byte: its suffix link is followed until some token begins with what is left."""
        grown = self.names[key >> 8] + chr(key & 255)
        while grown not in self.states:
            grown = grown[1:]
        to = self.states[grown]
        if self.matches[to] is None:
            ends = [(self.table.ids.get(grown[k:]), len(grown) - k) for k in range(len(grown))]
            self.matches[to] = tuple((t, n) for t, n in ends if t is not None and self.table.whole[t])
        if len(self.moves) >= 4 * self.limit:
            self.moves.clear()
        self.moves[key] = to
        return to

    def word(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        memo, compatible, moves, matches = self.table.memo, self.table.compatible, self.moves, self.matches
        last, back, state, at = [-1], [0], 0, 0
        for byte in raw:
            at += 1
            key = state << 8 | byte
            state = moves.get(key)
            if state is None:
                state = self._move(key)
            for token, length in matches[state]:
                if length < at:
                    previous = last[at - length]
                    fits = memo.get(previous << 20 | token)
                    if fits is None:
                        fits = compatible(previous, token)
                    if not fits:
                        continue
                last.append(token)
                back.append(at - length)
                break
        ids = []
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.special is not None and self.special.search(text):
            at = 0
            for m in self.special.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.table.specials[m.group()])
                at = m.end()
            self._plain(text[at:], out)
        else:
            self._plain(text, out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        memo = self.memo
        for piece in self.pieces.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.word(piece)
                if len(piece) <= 48:
                    if len(memo) >= self.limit:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)

    def decode(self, ids: list[int]) -> str:
        spelled = self.bytes
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str) -> PrefixCodec:
    return PrefixCodec(path)


@names_apart(named=("ids", "decoded"))
def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids array<int>`` and ``decoded string`` to every row.

    A null text counts as empty (no ids, empty decoded text); repeated rows stay; other columns pass through, but for those named as
    the two results, which are replaced.  Row-local: no shuffle, and each Arrow batch is bounded.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    keep = docs.drop(ids, decoded)
    work = keep.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{ids}` array<int>, `{decoded}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            found = [c.encode(x) for x in b.pop("__text")]
            b[ids] = found
            b[decoded] = [c.decode(x) for x in found]
            yield b

    return work.mapInPandas(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: the results of ``encode_decode`` digested where they are made."""
    made = encode_decode(docs.select("doc_id", "text"), path).select("doc_id", "token_ids", "decoded")
    return made.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

