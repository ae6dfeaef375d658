"""Fill-in-the-middle: documents cut in three and written in another order, by a table-driven automaton over bytes.

One table drives all: from a state and a byte it gives the next state and what the transition counts. States are: between
units, after `<`, after `<` and a sentinel's letter, and one to three continuation bytes of UTF-8 expected. Transitions
count units (code points begun) and sentinels (completed).

1. First scan: texts are read in chunks of CHUNK bytes, thousands side by side, each chunk with its counts. A state depends
   on the last three bytes only, so a chunk starts from the state that the REACH bytes before it lead to.
2. Cuts are units, so the counts before each chunk say which chunk holds a cut; a second scan of these chunks alone
   locates its byte.

Defined cases: null counts as the empty text, which is plain with no units; a null doc_id counts as the empty string; rows
are cut one by one, so repeated rows are cut alike; a very long text is scanned in passes of bounded memory; bytes that
are no UTF-8 count as units unless they continue one; an empty table gives no rows; other columns are kept by `transform`
(but for `form`, which is replaced) and ignored by `digest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import small_batches
from .workers import free

CHUNK, REACH, PASS_BYTES = 512, 3, 4 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are cut, and of 100 cut ones so many begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
#: A byte that no text has: it leaves the state and counts nothing.
NO_BYTE, WIDTH = np.int64(256), 257
BETWEEN, OPENED, LETTERED, ONE_MORE = 0, 1, 2, 3
SENTINEL = 1 << 32


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next states and counts by state * WIDTH + byte. A count is 1 for a unit begun and SENTINEL more for a sentinel."""
    step, count = np.zeros((6, WIDTH), np.uint8), np.zeros((6, WIDTH), np.int64)
    byte = np.arange(256)
    continues = (byte & 0xC0) == 0x80
    count[:, :256] = ~continues
    expected = np.select([byte >= 0xF0, byte >= 0xE0, byte >= 0xC0], [3, 2, 1], 0)
    step[:, :256] = np.where(expected > 0, ONE_MORE - 1 + expected, BETWEEN)
    for pending in (2, 3):
        step[ONE_MORE - 1 + pending, :256][continues] = ONE_MORE - 2 + pending
    step[:, ord("<")] = OPENED
    step[OPENED, [s[1] for s in (PREFIX, SUFFIX, MIDDLE)]] = LETTERED
    count[LETTERED, ord(">")] += SENTINEL
    step[:, NO_BYTE] = np.arange(6)
    return step.ravel(), count.ravel()


STEP, COUNT = compiled()


def _scan(blob: np.ndarray, begin: np.ndarray, size: np.ndarray, lead: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Runs the automaton over chunks side by side. Gives each chunk's counts, or, where units are `wanted` (the number of
    units of the chunk before it), the place of that unit in the chunk."""
    state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    found = np.full(len(begin), -1)
    for j in range(-REACH, int(size.max(initial=0))):
        inside = (j < size) & (j >= -lead)
        key = state * WIDTH + np.where(inside, blob[np.where(inside, begin + j, 0)], NO_BYTE)
        if j >= 0:
            counted = COUNT[key]
            if wanted is not None:
                found[(found < 0) & (counted % SENTINEL > 0) & (total % SENTINEL == wanted)] = j
            total += counted
        state = STEP[key].astype(np.int64)
    return total if wanted is None else found


class Scanned:
    """Some texts as one run of bytes, cut into chunks with their counts."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(-(-size // CHUNK))))  # first chunk of each text
        at = np.arange(self.first[-1]) - np.repeat(self.first[:-1], np.diff(self.first))
        offset = np.cumsum(size) - size
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.at, self.begin = at * CHUNK, np.repeat(offset, np.diff(self.first)) + at * CHUNK
        self.size = np.minimum(CHUNK, np.repeat(size, np.diff(self.first)) - self.at)
        self.lead = np.minimum(self.at, REACH)
        self.blob = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        rows = PASS_BYTES // CHUNK
        parts = [_scan(self.blob, *(x[i : i + rows] for x in (self.begin, self.size, self.lead))) for i in range(0, len(self.begin), rows)]
        counts = np.concatenate([*parts, np.zeros(0, np.int64)])
        self.before = np.concatenate(([0], np.cumsum(counts % SENTINEL)))  # units before each chunk
        marks = np.concatenate(([0], np.cumsum(counts // SENTINEL)))
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]
        self.sentinels = marks[self.first[1:]] - marks[self.first[:-1]]

    def places(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte of each text at which its unit of that number begins; its end for a number past the last."""
        out = np.array([len(self.texts[d]) for d in text.tolist()], np.int64)
        within = np.flatnonzero(unit < self.units[text])
        number = unit[within] + self.before[self.first[text[within]]]
        chunk = np.searchsorted(self.before, number, "right") - 1
        rows = PASS_BYTES // CHUNK
        for i in range(0, len(within), rows):
            c = chunk[i : i + rows]
            found = _scan(self.blob, self.begin[c], self.size[c], self.lead[c], number[i : i + rows] - self.before[c])
            out[within[i : i + rows]] = self.at[c] + found
        return out


def draws(doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the document's id."""
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that gave `output` in a form."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def cut(ids: list, texts: list[bytes]) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """(units, form, units of the prefix, units of the middle, output) of each text."""
    scanned = Scanned(texts)
    h = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    plain = (scanned.units == 0) | (scanned.sentinels > 0) | (h[:, 2] % 100 >= CUT)
    cuts = np.sort(h[:, :2] % (scanned.units[:, None] + 1), axis=1)
    some = np.flatnonzero(~plain)
    places = np.zeros((len(texts), 2), np.int64)
    for k in (0, 1):
        places[some, k] = scanned.places(some, cuts[some, k])
    for d, text in enumerate(texts):
        if plain[d]:
            yield int(scanned.units[d]), "plain", None, None, text
            continue
        (a, b), (i, j) = cuts[d].tolist(), places[d].tolist()
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        late = h[d, 3] % 100 < SUFFIX_FIRST
        out = SUFFIX + suffix + PREFIX + prefix if late else PREFIX + prefix + SUFFIX + suffix
        yield int(scanned.units[d]), "spm" if late else "psm", a, b - a, out + MIDDLE + middle


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int, list, list[bytes]]]:
    """The first row, ids and texts of some bytes at a time; a longer text is a slice of its own."""
    i, size, held = 0, 0, []
    for k in range(len(texts)):
        value = texts[k]
        held.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
        size += len(held[-1])
        if size >= PASS_BYTES or k + 1 == len(texts):
            yield i, ids.slice(i, len(held)).to_pylist(), held
            i, size, held = k + 1, 0, []


def _transformed(batches: Iterator[pa.RecordBatch], id: int, text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    free()
    for batch in batches:
        for i, ids, texts in _slices(batch.column(id), batch.column(text)):
            done = list(cut(ids, texts))
            columns = [c.slice(i, len(ids)) for c in batch.columns]
            columns[text] = pa.array([x[4] for x in done], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.string())], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        for i, ids, texts in _slices(batch.column(0), batch.column(1)):
            rows = [(n, form, a, m, sha(out), sha(rebuilt(out, form))) for n, form, a, m, out in cut(ids, texts)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(ids)), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])


def transform(docs: DataFrame) -> DataFrame:
    """`docs` with each text in its form, and the form; a null text becomes empty."""
    small_batches(docs.sparkSession)
    docs = docs.drop("form")
    id, text = docs.columns.index("doc_id"), docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("form", T.StringType())])
    return docs.mapInArrow(lambda it: _transformed(it, id, text, schema.names), schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per document."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_digested, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
