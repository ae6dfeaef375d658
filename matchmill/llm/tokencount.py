"""Token counts of a byte-level BPE by finite-state transducers whose transitions carry emitted-token counts.

The merge rules are compiled into a deterministic transducer over bytes. After each byte its state knows the last token
of the best encoding at every recent place, so the next byte decides the next state and by how much the number of tokens
changes. States are made when they are first met and kept by the worker process; a word costs one look-up per byte, and
its count is remembered.

A text is cut into chunks. A chunk's map is what it emits for whatever state it is entered in: after a non-space that
stands before a space every state is the initial one, so a chunk is a head, the count between its first and last such
place, and a tail. Maps compose associatively, and a tree of them gives the count of the text.

Defined cases: null counts as the empty text, with no tokens; the special string inside a text is one token; rows are
counted one by one, so repeated rows and null ids stay as they are; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import kept

CHUNK_CHARS = 1 << 16
#: Bytes that a worker spends on remembered counts before it starts anew; each entry counts ENTRY.
REMEMBERED, ENTRY = 128 << 20, 120
#: Transducer states after which it is emptied and filled again.
MOST_STATES = 250_000
#: Fixed value: how this vocabulary cuts a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space and what follows it, where no white space but ASCII's occurs: units between places that reset the state.
UNITS = re.compile(r"\s*\S+|\s+", re.ASCII)
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RESET = regex.compile(r"(?<=\S)(?=\s)")
LAST_RESET = regex.compile(r"(?r)(?<=\S)(?=\s)")


def byte_symbols() -> dict[str, int]:
    """Vocabulary files write a byte as a printable character: itself if it is one, else the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + i)] = b
    return out


class Transducer:
    """step(state, byte) gives the next state and the change of the number of tokens; state 0 is the beginning of a word."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        symbols = byte_symbols()
        raw = lambda t: bytes(symbols[c] for c in t)
        special = {t["content"] for t in model["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.id = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for m in model["model"]["merges"]:
            x, y = (raw(t) for t in (m.split(" ") if isinstance(m, str) else m))
            self.made[self.id[x], self.id[y]] = self.id[x + y]
            self.halves[self.id[x + y]] = self.id[x], self.id[y]
        self.prefixes = {t[:i] for t in self.id for i in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((-1, 0),))
        self.number = {start: 0}
        self.states = [start]
        self.moves: dict[int, tuple[int, int]] = {}
        self.fits.clear()

    def fit(self, last: int, token: int) -> bool:
        """Whether the merge rules leave these two tokens apart; numbers of tokens grow in the order of the rules.

        The pair is taken apart along its inner border, the younger token first. A rule that would join what meets there
        before the token taken apart last was made breaks the pair."""
        if last < 0:
            return True
        if (known := self.fits.get((last, token))) is not None:
            return known
        x, y, before = last, token, 1 << 60
        known = True
        while True:
            if self.made.get((x, y), 1 << 60) < before:
                known = False
                break
            if x not in self.halves and y not in self.halves:
                break
            if y not in self.halves or (x in self.halves and x > y):
                before, x = x, self.halves[x][1]
            else:
                before, y = y + 1, self.halves[y][0]
        self.fits[last, token] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """A state is the longest recent string that begins a token, and for each place in it the last token there and
        the number of tokens up to there less the number now."""
        recent, places = self.states[state]
        grown = recent + bytes((byte,))
        for i in range(len(grown)):
            token = self.id.get(grown[i:])
            if token is not None and self.fit(places[i][0], token):
                change = places[i][1] + 1
                break
        else:
            raise ValueError(f"no token ends with byte {byte} here")
        cut = next(i for i in range(len(grown) + 1) if grown[i:] in self.prefixes or i == len(grown))
        key = (grown[cut:], tuple((t, n - change) for t, n in places[cut:]) + ((token, 0),))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = to, change
        return to, change

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.clear()
        state = total = 0
        moves = self.moves
        for byte in word:
            move = moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            total += move[1]
        return total


class Counts(dict):
    """Token counts of units of one or more words, filled when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.spent = 0

    def __missing__(self, unit: str) -> int:
        if self.spent > REMEMBERED:
            self.clear()
            self.spent = 0
        self.spent += ENTRY + 4 * len(unit)
        n = self[unit] = sum(self.transducer.count(w.encode("utf-8", "surrogatepass")) for w in WORDS.findall(unit))
        return n


def chunk_map(text: str, counts: Counts) -> tuple[str, int | None, str]:
    """(head, count, tail); a chunk without a place that resets the state is all head, and its count is None."""
    if (first := RESET.search(text)) is None:
        return text, None, ""
    a, b = first.start(), LAST_RESET.search(text).start()
    return text[:a], whole(text[a:b], counts), text[b:]


def compose(x: tuple[str, int | None, str], y: tuple[str, int | None, str], counts: Counts) -> tuple[str, int | None, str]:
    """The map of two neighbouring chunks: what lies between the resets of both is settled now."""
    if x[1] is None and y[1] is None:
        return chunk_map(x[0] + y[0], counts)
    if x[1] is None:
        head, n, rest = chunk_map(x[0] + y[0], counts)
        return (head, y[1], y[2]) if n is None else (head, n + whole(rest, counts) + y[1], y[2])
    if y[1] is None:
        rest, n, tail = chunk_map(x[2] + y[0], counts)
        return (x[0], x[1], rest) if n is None else (x[0], x[1] + whole(rest, counts) + n, tail)
    return x[0], x[1] + whole(x[2] + y[0], counts) + y[1], y[2]


def whole(text: str, counts: Counts) -> int:
    return sum(map(counts.__getitem__, (WORDS if ODD_SPACE.search(text) else UNITS).findall(text)))


def count_text(text: str, counts: Counts, chunk: int = CHUNK_CHARS) -> int:
    pieces = counts.transducer.special.split(text) if counts.transducer.special else [text]
    total = len(pieces) - 1
    for piece in pieces:
        if len(piece) <= chunk:
            total += whole(piece, counts)
            continue
        maps = [chunk_map(piece[i : i + chunk], counts) for i in range(0, len(piece), chunk)]
        while len(maps) > 1:
            maps = [compose(*maps[i : i + 2], counts) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        total += whole(head, counts) + (n or 0) + whole(tail, counts)
    return total


def counts_for(path: str) -> Counts:
    return kept(("counts", path), lambda: Counts(Transducer(path)))


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _counted(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    counts = counts_for(path or vocabulary("byte_bpe_50k.json"))
    gc.disable()  # states and counts stay; looking through them for cycles again and again costs more than the work
    try:
        for batch in batches:
            n = [count_text(t, counts) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])
    finally:
        gc.enable()


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row. path: a byte-level BPE file that every executor can open; by
    default the installed byte_bpe_50k.json."""
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInArrow(lambda it: _counted(it, path), f"doc_id {kind}, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
