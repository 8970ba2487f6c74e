"""Token counts by a finite-state transducer that is compiled as texts need it.

States hold what the greedy merge encoding of a word can still depend on: the longest suffix read so far that begins some vocabulary
token, with the last token and the relative token count at each of its positions.  Pre-token boundaries are states too.  Each
transition is annotated with the number of tokens it emits (less than 0 where a merge takes tokens back).

A long text is read in chunks, by tasks of their own.  A chunk's map leads from entry states to exit states and counts.  It starts with
the one entry that the end of the chunk before suggests; every exit of a chunk that the next one has no entry for is then read by that
one too, until the maps are closed.  The states of a text are finitely many, so this ends.  Closed maps compose associatively, and a
prefix scan over blocks of chunks, again in tasks, gives the text's total.
"""

from __future__ import annotations

import ast
import gc
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.bpe import END, merge_table, special_strings, tokenizer_path
from prismatica.llm.common import checkpoint, has_rows, names_apart, small_batches

#: Code points of one chunk; it goes on to the next place where a text may be cut.
CHUNK = 32_768
#: Code points before a chunk from which its entry state is guessed.
BACK = 256
#: Chunks, or blocks of them, that one step of the scan composes.
FAN = 64
#: Characters before which a text may be cut, for java.util.regex: normalisation never joins them with what comes before.
CUT_BEFORE = r"[\p{L}\p{N}\p{P}\p{S}\p{Z}\x00-\x7f&&[^\u1100-\u11ff\x{16d40}-\x{16d7f}]]"
#: Contractions that the vocabulary's pre-token pattern cuts off, by the letters after the apostrophe.
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}

#: Modes of the pre-token part of a state.
BETWEEN, LETTERS, OTHER, APOSTROPHE, HALF = range(5)


@contextmanager
def uncollected():
    """Python's cycle collector rests: it would walk through all compiled rows again and again, whose cycles are broken by hand."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Transducer:
    """``limit`` bounds the compiled transitions, and the contexts' shapes; a table is emptied and compiled anew when full."""

    empty = ("", ((-1, 0),))  # nothing read of a word: one position, no token before it
    START = (BETWEEN, empty, "")

    def __init__(self, path: str, limit: int = 250_000):
        self.table, self.limit, self.size = merge_table(path), limit, 0
        self.begins = {s[:n] for s in self.table.ids for n in range(1, len(s))}  # what a longer token can begin with
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.table.specials, key=len, reverse=True)) or "(?!)")
        self.rows: dict[tuple, dict] = {}
        self.shapes: dict[str, tuple] = {}
        self.start = self.row(self.START)

    def row(self, state: tuple) -> dict:
        found = self.rows.get(state)
        if found is None:
            found = self.rows[state] = {None: state}
        return found

    def byte(self, word: tuple, b: str) -> tuple[tuple, int]:
        """One more byte of a word: the next word state and the change of its token count."""
        context, marks = word
        grown = context + b
        ends, held, kept = self.shapes.get(grown) or self.shape(grown)
        known, compatible = self.table.memo, self.table.compatible
        for k, token in ends:
            before, n = marks[k]  # never dropped: a token that starts here goes on to this byte
            if before < 0:
                break
            fits = known.get(before << 20 | token)
            if compatible(before, token) if fits is None else fits:
                break
        count = n + 1
        return (held, (*[m and (m[0], m[1] - count) for m in [k if k is None else marks[k] for k in kept]], (token, 0))), count

    def shape(self, grown: str) -> tuple:
        """What depends on the letters alone, in many states: the tokens that end here with their starts, longest first; the next context;
        and the positions that it keeps, None for those where no longer token begins."""
        suffixes = [grown[k:] for k in range(len(grown))]
        tokens = [self.table.ids.get(x) for x in suffixes]
        begins = [x in self.begins for x in suffixes]
        cut = begins.index(True) if True in begins else len(grown)
        if len(self.shapes) >= self.limit:
            self.shapes.clear()
        found = tuple((k, t) for k, t in enumerate(tokens) if t is not None and self.table.whole[t]), grown[cut:], tuple(k if begins[k] else None for k in range(cut, len(grown)))
        self.shapes[grown] = found
        return found

    def close(self, word: tuple) -> int:
        """The change of the token count when the word ends here: its last byte is then one symbol with the end mark."""
        context, marks = word
        for k in range(len(context)):
            token = self.table.ids.get(context[k:] + END)
            if token is not None and self.table.whole[token] and (marks[k][0] < 0 or self.table.compatible(marks[k][0], token)):
                return marks[k][1] + 1
        return 0

    def letters(self, word: tuple, ch: str) -> tuple[tuple, int]:
        emitted = 0
        for b in ch if ch.isascii() else ch.encode("utf-8", "surrogatepass").decode("latin-1"):
            word, n = self.byte(word, b)
            emitted += n
        return word, emitted

    def step(self, state: tuple, ch: str) -> tuple[tuple, int]:
        """The transition of a state on a character, or on "" for the end of the text."""
        mode, word, held = state
        if mode == APOSTROPHE and ch in CONTRACTIONS and ch:
            if CONTRACTIONS[ch]:
                return (HALF, word, ch), 0
            word, n = self.letters(word, ch)
            return (BETWEEN, self.empty, ""), n + self.close(word)
        if mode == HALF:
            if ch and ch == CONTRACTIONS[held]:
                word, n = self.letters(word, held + ch)
                return (BETWEEN, self.empty, ""), n + self.close(word)
            inner, n = self.letters(self.empty, held)
            after, m = self.step((LETTERS, inner, ""), ch)
            return after, self.close(word) + n + m
        kind = unicodedata.category(ch)[0] if ch else "Z"
        if ch and kind != "L" and kind != "N" and not is_space(ch):
            if mode == OTHER or mode == APOSTROPHE:
                word, n = self.letters(word, ch)
                return (OTHER, word, ""), n
            closed = self.close(word) if mode != BETWEEN else 0
            word, n = self.letters(self.empty, ch)
            return (APOSTROPHE if ch == "'" else OTHER, word, ""), closed + n
        closed = self.close(word) if mode != BETWEEN and not (mode == LETTERS and kind == "L") else 0
        if not ch or is_space(ch):
            return (BETWEEN, self.empty, ""), closed
        if kind == "N":
            word, n = self.letters(self.empty, ch)
            return (BETWEEN, self.empty, ""), closed + n + self.close(word)
        word, n = self.letters(word if mode == LETTERS else self.empty, ch)
        return (LETTERS, word, ""), closed + n

    def compile(self, row: dict, ch: str) -> tuple[dict, int]:
        if self.size >= self.limit:
            kept = [row[None], self.start[None]]
            for r in self.rows.values():  # rows refer to each other
                r.clear()
            self.rows.clear()
            self.size = 0
            row[None], self.start[None] = kept
            self.rows[kept[0]], self.rows[kept[1]] = row, self.start
        state, emitted = self.step(row[None], ch)
        self.size += 1
        row[ch] = found = (self.row(state), emitted)
        return found

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """Exit state and count of a text that is entered in ``state``; special strings stand between words."""
        row, total, compile_ = self.row(state), 0, self.compile
        for i, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            if i:
                row, n = row.get("") or compile_(row, "")
                total += n + 1
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            rest = iter(part.lower())
            while True:
                try:
                    for ch in rest:
                        row, n = row[ch]
                        total += n
                    break
                except KeyError:  # a transition that isn't compiled yet
                    row, n = compile_(row, ch)
                    total += n
        return row[None], total

    def run_to_end(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The same where the text ends."""
        state, n = self.run(state, text)
        state, m = self.step(state, "")
        return state, n + m

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.run_to_end(self.START, text)[1]

    def counts(self, texts: Iterable[str]) -> list[int]:
        with uncollected():
            return [self.count(t) for t in texts]


def is_space(ch: str) -> bool:
    return ch.isspace() and ch not in "\x1c\x1d\x1e\x1f"


#: What a chunk does to the states it was entered in, written as text: exit state and count of each.
ChunkMap = dict[str, tuple[str, int]]


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of two neighbours, for the entries of the first that the second has an entry for."""
    return {entry: (b[exit][0], n + b[exit][1]) for entry, (exit, n) in a.items() if exit in b}


def cut_pattern(specials: list[str]) -> str:
    """One chunk, for java.util.regex: CHUNK code points, and then all up to the next place outside special strings where a text may
    be cut.  Possessive quantifiers need no stack."""
    inside = "".join(rf"|(?<=\Q{s[:i]}\E)(?=\Q{s[i:]}\E)" for s in specials for i in range(1, len(s)))
    return f"(?s).{{1,{CHUNK}}}+(?:(?:(?!{CUT_BEFORE}){inside}).)*+"


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@names_apart(replaced=("n_bytes", "n_tokens", "over_limit"))
def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, text: str = "text") -> DataFrame:
    """Every row with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); repeated rows stay; columns named as the results are replaced.  Texts of at most
    CHUNK bytes are counted where they lie.  Longer ones go in chunks, equal texts once, to tasks that know nothing of each other, so
    Python holds no long text whole.  A run of combining marks is never cut.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    results = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in (text, *results)]
    others = [F.col(f"`{c}`") for c in keep]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*others, whole.alias("__text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    types = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "n_bytes long", "n_tokens long"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for b in batches:
            out = b[[*keep, "n_bytes"]].copy()
            out["n_tokens"] = machine.counts(b["__text"])
            yield out

    short = rows.where(F.col("n_bytes") <= CHUNK).mapInPandas(count, types)
    # Equal texts have equal counts, so a text's digest is its key; the join's key is a struct, so that Spark can split a hot one.
    long = rows.where(F.col("n_bytes") > CHUNK).withColumn("__key", F.unhex(F.md5("__text")))
    totals = _long_counts(long.select("__key", "__text"), path).select(F.struct("__key").alias("__same"), "n_tokens")
    counted = long.select(*others, "n_bytes", F.struct("__key").alias("__same")).join(totals, "__same").select(*others, "n_bytes", "n_tokens")
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)


def _long_counts(long: DataFrame, path: str) -> DataFrame:
    """__key and n_tokens of every different text of ``long`` (__key, __text)."""
    pattern = cut_pattern(special_strings(path))
    cut = long.select("__key", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)).alias("__pieces"))
    before = F.concat(F.array(F.lit("")), F.transform("__pieces", lambda x: F.right(x, F.lit(BACK))))
    zipped = F.slice(F.arrays_zip(F.col("__pieces").alias("piece"), before.alias("before")), 1, F.size("__pieces"))
    cut = cut.select("__key", (F.size("__pieces") - 1).alias("end"), F.posexplode(zipped).alias("chunk", "p"))
    # Spreads the chunks of a text over tasks; of equal texts one is kept, before and after the shuffle.
    pieces = cut.select("__key", "chunk", (F.col("chunk") == F.col("end")).alias("last"), "p.piece", "p.before").dropDuplicates(["__key", "chunk"])
    shape = "__key binary, chunk int, last boolean, entry string, exit string, n long"

    def read(machine: Transducer, b: pd.DataFrame, entries: list[tuple]) -> pd.DataFrame:
        with uncollected():
            ends = [(machine.run_to_end if last else machine.run)(entry, piece) for entry, piece, last in zip(entries, b["piece"], b["last"], strict=True)]
        return pd.DataFrame({"__key": b["__key"], "chunk": b["chunk"], "last": b["last"], "entry": map(repr, entries), "exit": [repr(e) for e, _ in ends], "n": [n for _, n in ends]})

    def read_guessed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for b in batches:
            yield read(machine, b, [machine.run(machine.START, x)[0] for x in b["before"]])

    def read_entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for b in batches:
            yield read(machine, b, list(map(ast.literal_eval, b["entry"])))

    maps = checkpoint(pieces.mapInPandas(read_guessed, shape))
    while True:
        reached = maps.where("not last").select("__key", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry")).distinct()
        missing = reached.join(maps, ["__key", "chunk", "entry"], "left_anti")
        if not has_rows(missing):
            break
        entered = pieces.join(missing, ["__key", "chunk"]).select("chunk", "__key", "last", "piece", "entry")
        maps = checkpoint(maps.unionByName(entered.mapInPandas(read_entered, shape)))

    def fold(block: pd.DataFrame) -> pd.DataFrame:
        of_chunk: dict[int, ChunkMap] = defaultdict(dict)
        for chunk, entry, exit, n in zip(block["chunk"], block["entry"], block["exit"], block["n"], strict=True):
            of_chunk[chunk][entry] = exit, n
        whole = reduce(compose, (of_chunk[c] for c in sorted(of_chunk)))
        out = pd.DataFrame([(e, x, n) for e, (x, n) in whole.items()], columns=["entry", "exit", "n"])
        return out.assign(__key=[block["__key"].iloc[0]] * len(out), chunk=block["chunk"].iloc[0] // FAN)

    scanned = maps.select("__key", "chunk", "entry", "exit", "n")
    while has_rows(scanned.where("chunk > 0")):
        block = F.floor(F.col("chunk") / FAN)
        scanned = checkpoint(scanned.groupBy("__key", block).applyInPandas(fold, "__key binary, chunk int, entry string, exit string, n long"))
    return scanned.where(F.col("entry") == repr(Transducer.START)).select("__key", F.col("n").alias("n_tokens"))
