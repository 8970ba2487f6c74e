"""Byte-pair merge tables of public tokenizers, and the pair test that decides whether two tokens may stand side by side."""

from __future__ import annotations

import json
from functools import lru_cache

#: Marks the end of a word in token strings; all other characters stand for one byte each.
END = "Ā"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_strings(path: str) -> list[str]:
    """Strings that the vocabulary takes out of texts before all else."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Tokens as strings of bytes (Latin-1, with END for a word's end), the merge that makes each, and the pair test.

    ``limit`` bounds the memo of pair tests; it is emptied when full.
    """

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""

        def spell(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix)
            body = token[: len(token) - len(suffix)] if ends else token
            return "".join(chr(letters[c]) for c in body) + (END if ends else "")

        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.spelled = [""] * size
        self.ids: dict[str, int] = {}
        for token, i in vocab.items():
            if token not in self.specials:
                self.spelled[i] = spell(token)
                self.ids[self.spelled[i]] = i
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if suffix and a.endswith(suffix):
                continue
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault(x << 20 | y, r)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        self.limit, self.memo = limit, {}
        self.whole = [self._stands(i) for i in range(size)]

    def _undone(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge crosses the boundary between a and b in a rank below limit.

        The side made later is taken apart first, back to single bytes; a crossing pair that would have merged before that side was
        made shows that the two tokens never come to stand side by side.
        """
        rank, pairs = self.rank, self.pairs
        while True:
            crossing = pairs.get(a << 20 | b)
            if crossing is not None and crossing < limit:
                return False
            made_a, made_b = rank[a], rank[b]
            if made_a > made_b:
                limit, a = made_a, self.right[a]
            elif made_b >= 0:
                limit, b = made_b + 1, self.left[b]
            else:
                return True

    def _stands(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as this one token."""
        return self.rank[token] < 0 or self._undone(self.left[token], self.right[token], self.rank[token])

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            known = self.memo[key] = self._undone(a, b, 1 << 60)
        return known


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)
