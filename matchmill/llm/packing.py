"""Packing into sequences of tokens along a space-filling curve.

A document's vector is the sum of one hashed random direction per token, that is a hashed bag of tokens projected to
three dimensions. Its coordinates are squashed to 10 bits each and give a key on the Hilbert curve. Documents are
range-sorted by that key, and each range packs its documents one after the other, so neighbours share sequences.

Sequences of one range are full but for its end. What is left there is cut into sequences whose lengths are powers of
two, which need no padding.

Defined cases: null counts as the empty text, which is the end token alone; equal keys are ordered by doc_id, so many
equal documents spread over ranges; a null doc_id is packed like any; a very long text is cut over many sequences; rows
are packed one by one, repeated ones too; with no rows there are no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches, written
from .tokencount import ODD_SPACE, byte_symbols, vocabulary
from .workers import free, kept

LENGTH, END_ID = 2048, 1
DIMENSIONS, KEY_BITS = 3, 10
#: Bytes that a worker spends on remembered words, and twice that on parts of words, before it starts anew; each entry
#: counts ENTRY.
REMEMBERED, ENTRY = 24 << 20, 160
#: Bytes of ids in one range of the curve.
RANGE_BYTES = 32 << 20
#: Fixed value: how this vocabulary cuts lower-case text into parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _latin(*kinds: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] in kinds)


#: The same for text of the first 256 code points, whose classes are short, and what such a text must not hold.
LATIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[^ \t\n\r\f\v{_latin('L', 'N')}]+")
NOT_LATIN = re.compile(r"[^\x20-\x7e\xa1-\xac\xae-\xff\t\n\r\f\v]")


class PartIds(dict):
    """Ids of parts of words by the library's model, as unsigned 16-bit numbers, filled when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model, self.spent = model, 0
        self.symbols = {b: c for c, b in byte_symbols().items()}

    def __missing__(self, part: str) -> bytes:
        if self.spent > 2 * REMEMBERED:
            self.clear()
            self.spent = 0
        symbols = part if part.isascii() else "".join(self.symbols[b] for b in part.encode())
        ids = self[part] = array("H", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        self.spent += ENTRY + 4 * len(part) + len(ids)
        return ids


class WordIds(dict):
    """Ids of words between ASCII white space, as unsigned 16-bit numbers, filled when first asked for.

    Text of the first 256 code points needs only lower case before the library's model takes its parts, so a whole text
    of them is cut at once. Other texts go word by word, and words of other code points through the whole library
    tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_in = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").search
        self.parts = PartIds(self.tokenizer.model)
        self.spent = 0

    def __missing__(self, word: str) -> bytes:
        if self.spent > REMEMBERED:
            self.clear()
            self.spent = 0
        plain = word.isascii() or max(word) < "Ā"
        if plain and not self.special_in(word) and word.isprintable():
            ids = b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        self[word] = ids
        self.spent += ENTRY + 4 * len(word) + len(ids)
        return ids

    def text(self, text: str) -> bytes:
        if not NOT_LATIN.search(text) and not self.special_in(text):
            return b"".join(map(self.parts.__getitem__, LATIN_PARTS.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.split() if not ODD_SPACE.search(text) else regex.findall(r"[^ \t\n\r\f\v]+", text)))


def ids_for(path: str) -> WordIds:
    return kept(("ids", path), lambda: WordIds(path))


@lru_cache(1)
def directions() -> np.ndarray:
    """A hashed random direction for every 16-bit id."""
    return np.random.default_rng(4242).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Keys on the Hilbert curve of points with unsigned coordinates of so many bits, by Skilling's transposition."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The mean direction of a document's ids, as large as its distance from chance allows, squashed to coordinates."""
    sums = np.array([directions()[i].sum(0) / np.sqrt(len(i)) for i in ids], np.float64).reshape(-1, DIMENSIONS)
    spread = 1 / (1 + np.exp(-sums / 8))
    return hilbert(np.minimum(spread * (1 << KEY_BITS), (1 << KEY_BITS) - 1).astype(np.int64))


def _tokenized(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    words = ids_for(path or vocabulary("word_bpe_49k.json"))
    end = np.array([END_ID], "<u2").tobytes()
    gc.disable()
    try:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [words.text(t or "") + end for t in part.column(1).to_pylist()]
                keys = curve_keys([np.frombuffer(x, "<u2") for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "curve", "n", "ids"])
    finally:
        gc.enable()


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(batches: Iterator[pa.RecordBatch], length: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces of one range. Those of the sequence that is being filled wait, so that the last can be cut into powers of two."""
    from pyspark import TaskContext

    free()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    number = TaskContext.get().partitionId() << 33
    waiting: list[tuple] = []  # doc_id, start, ids, doc_tokens
    used, out = 0, []

    def close(size: int) -> None:
        """The first `size` tokens that wait become a sequence."""
        nonlocal number, used
        at = 0
        while at < size:
            doc, start, ids, total = waiting.pop(0)
            if len(ids) > size - at:
                waiting.insert(0, (doc, start + size - at, ids[size - at :], total))
                ids = ids[: size - at]
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at))
            at += len(ids)
        used -= size
        number += 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(ids.as_buffer(), "<u2")
            start, total = 0, len(ids)
            while start < total:
                take = min(total - start, length - used)
                waiting.append((doc, start, ids[start : start + take], total))
                used, start = used + take, start + take
                if used == length:
                    close(length)
        if out:
            yield batch_of(out)
            out.clear()
    while used:
        close(1 << (used.bit_length() - 1))
    if out:
        yield batch_of(out)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of a document. `length` is a power
    of two. The ids are written before the range sort, so its sampling reads them and doesn't tokenize again; the number
    of ranges follows their size."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    ids = docs.select("doc_id", "text").mapInArrow(lambda it: _tokenized(it, path), f"doc_id {kind}, curve long, n long, ids binary")
    ids = written(ids, "token-ids")
    size = ids.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    sorted_ = ids.repartitionByRange(partitions, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "ids")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = T.StructType([T.StructField("doc_id", ids.schema["doc_id"].dataType), *T._parse_datatype_string(PIECES).fields])
    return sorted_.mapInArrow(lambda it: _packed(it, length, arrow), schema)
