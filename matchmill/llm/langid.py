"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions and labels every byte with probabilities of the languages; a
document's probabilities are the means over all its bytes. It is trained in numpy by backpropagation through time on a
bounded sample. Its gates and candidates use x / (1 + |x|) as their curve, which costs no transcendental function.

A text is read in rows of SPAN bytes that run side by side. The state is carried through a row, over words and spaces
alike, and each row begins CONTEXT bytes before its span and ends as many after it, so that both directions come to the
span with a state from the text around it; those bytes are labelled in the neighbouring rows. Nothing is cut by spaces,
so scripts without them are read like the others, and a text of any length is read whole in bounded memory.

Parameters that bound the sample: SAMPLE_DOCS documents a language, in expectation, chosen by a hash of their ids, of
each SAMPLE_CHARS characters from a hashed place; SAMPLE_TOTAL documents in all, shared evenly by the languages.

A text is recognised from a score on that follows its length: LEAST_SHARE of the way from an even guess (one over the number
of languages) to 1, or SPREADS standard deviations below the mean score of held-out texts of that length, if that is less.
Lengths go by powers of two, and every held-out text is cut into pieces of each length, one after the other, so the scores come from
every byte of all of them (the last piece ends with the text and may lie over the one before); a language weighs as its held-out documents do, but at most as those that the sample would have of it. The scores of
short pieces are low and spread, so a short text is hardly ever rejected. Where fewer than LEAST_RIGHT of the held-out texts are labelled as they were
given, or there is nothing to learn from or fewer than LEAST_CHECKED documents to check on, every text with a letter counts
as recognised.

Defined cases: a null text or one without a letter is `und` with score 0; with nothing to learn from every document is
`und`; of equally likely languages the first by name is given; a null doc_id counts as the empty string for held_out;
rows are labelled one by one, repeated ones alike; columns of the input that have the names of the new ones are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches
from .workers import free

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 250, 4096, 4000
HIDDEN, WINDOW, STEPS, BATCH, RATE = 12, 64, 300, 128, 1e-2
SPAN, CONTEXT, ROWS = 448, 32, 1024
LEAST_SHARE, LEAST_RIGHT, LEAST_CHECKED, PIECES, SPREADS = 0.1, 0.9, 20, 4, 4.0
#: Powers of two of the lengths that held-out pieces have.
LENGTHS = range(13)
#: Bytes of pieces that are counted before they are scored.
BLOCK = 1 << 21
#: Scores are summed in whole parts, so the sums don't depend on the order of rows.
UNITS = 1 << 30
UNKNOWN = "und"
LETTER = r"\p{L}"


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of the bounded training sample, in a fixed order."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not counts:
        return []
    each = min(SAMPLE_DOCS, max(1, SAMPLE_TOTAL // len(counts)))
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["n"])))))
    place = F.xxhash64(F.lit("langid"), "doc_id")
    some = rows.filter(F.pmod(place, F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    start = F.pmod(F.shiftright(place, 20), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    got = some.withColumn("start", start.cast("int")).select("lang", F.expr(f"substring(text, start, {SAMPLE_CHARS})").alias("text"))
    return sorted((r["lang"], r["text"]) for r in got.collect())


def side_by_side(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows, the longest first, as columns of a matrix of bytes, and how many of them reach each place."""
    n = np.array([len(r) for r in rows], np.int64)
    width = max(1, int(n.max())) if len(n) else 1
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width).T
    return np.ascontiguousarray(x), np.searchsorted(-n, -np.arange(width), "left")


def initial(classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"o": rng.normal(0, 0.3, (2 * HIDDEN, classes)), "ob": np.zeros(classes)}
    for d in "fb":
        p |= {f"{d}x": rng.normal(0, 0.3, (256, 3 * HIDDEN)), f"{d}h": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), f"{d}c": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def layers(x: np.ndarray) -> np.ndarray:
    """Columns of the update gate, the reset gate and the candidate, each by itself."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def _places(d: str, width: int) -> range:
    return range(width) if d == "f" else range(width - 1, -1, -1)


def run(p: dict, d: str, x: np.ndarray, reach: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """States (places, rows, HIDDEN) of direction d. Rows that don't reach a place stand at the end, so a step takes the
    first ones only. The two gates and the candidate are three layers of one array. tape gets what backpropagation needs."""
    width, rows = x.shape
    table, mix = layers(p[f"{d}x"] + p[f"{d}c"]), layers(p[f"{d}h"])
    states = np.zeros((width, rows, HIDDEN), table.dtype)
    h = np.zeros((rows, HIDDEN), table.dtype)
    put, own, scale = (np.empty((3, rows, HIDDEN), table.dtype) for _ in range(3))
    for t in _places(d, width):
        a = reach[t]
        now, at, sums, by = h[:a], put[:, :a], own[:, :a], scale[:, :a]
        for k in range(3):
            np.take(table[k], x[t, :a], axis=0, out=at[k], mode="clip")
            np.matmul(now, mix[k], out=sums[k])
        at[:2] += sums[:2]
        np.abs(at[:2], out=by[:2])
        by[:2] += 1
        at[:2] /= by[:2]
        at[:2] *= 0.5
        at[:2] += 0.5
        z, r, u, n = at[0], at[1], sums[2], at[2]
        n += np.multiply(r, u, out=by[2])
        np.abs(n, out=by[2])
        by[2] += 1
        n /= by[2]
        if tape is not None:
            tape[t] = now.copy(), z.copy(), r.copy(), u.copy(), n.copy()
        now -= n
        now *= z
        now += n
        states[t, :a] = now
    return states


def labels(p: dict, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Language probabilities of every byte, (languages, places, rows), a few places at a time."""
    f, b = run(p, "f", x, reach), run(p, "b", x, reach)
    width, rows = x.shape
    step = max(1, (1 << 19) // (rows * len(p["ob"])))
    for t in range(0, width, step):
        logits = p["o"][:HIDDEN].T @ f[t : t + step].reshape(-1, HIDDEN).T
        logits += p["o"][HIDDEN:].T @ b[t : t + step].reshape(-1, HIDDEN).T
        logits += p["ob"][:, None]
        logits -= logits.max(0)
        e = np.exp(logits, out=logits)
        e /= e.sum(0)
        yield t, e.reshape(len(e), -1, rows)


def gradients(p: dict, x: np.ndarray, reach: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over bytes and its gradient by backpropagation through time."""
    width, rows = x.shape
    tapes: dict[str, dict] = {"f": {}, "b": {}}
    both = np.concatenate([run(p, d, x, reach, tapes[d]) for d in "fb"], -1)
    logits = both @ p["o"] + p["ob"]
    q = np.exp(logits - logits.max(-1, keepdims=True))
    q /= q.sum(-1, keepdims=True)
    inside = np.arange(rows)[None, :] < reach[:, None]
    total = inside.sum()
    loss = -(np.log(q[:, np.arange(rows), y] + 1e-9) * inside).sum() / total
    q[:, np.arange(rows), y] -= 1
    q *= (inside / total)[..., None]
    q = q.astype(both.dtype)
    g = {"o": both.reshape(-1, 2 * HIDDEN).T @ q.reshape(-1, q.shape[-1]), "ob": q.sum((0, 1))}
    back = q @ p["o"].T
    for d, part in (("f", back[..., :HIDDEN]), ("b", back[..., HIDDEN:])):
        gh, dh = np.zeros_like(p[f"{d}h"]), np.zeros((rows, HIDDEN), both.dtype)
        into = np.zeros((width, rows, 3 * HIDDEN), both.dtype)
        for t in reversed(_places(d, width)):
            a = reach[t]
            h, z, r, u, n = tapes[d][t]
            on = dh[:a] + part[t, :a]
            dn = on * (1 - z) * (1 - np.abs(n)) ** 2
            slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            dz, dr = on * (h - n) * slope(z), dn * u * slope(r)
            own = np.concatenate((dz, dr, dn * r), 1)
            into[t, :a] = np.concatenate((dz, dr, dn), 1)
            gh += h.T @ own
            dh[:a] = on * z + own @ p[f"{d}h"].T
        flat, read = into.reshape(-1, 3 * HIDDEN), x.reshape(-1)
        order = np.argsort(read, kind="stable")
        found, first = np.unique(read[order], return_index=True)
        gx = np.zeros_like(p[f"{d}x"])
        gx[found] = np.add.reduceat(flat[order], first)
        g |= {f"{d}x": gx, f"{d}h": gh, f"{d}c": flat.sum(0)}
    return float(loss), g


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 0) -> tuple[list[str], dict]:
    """(languages, parameters): Adam over batches of windows of texts, languages drawn evenly."""
    langs = sorted({lang for lang, _ in rows})
    texts = [[text.encode("utf-8", "surrogatepass") for lang, text in rows if lang == k] for k in langs]
    p, rng = initial(len(langs), seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(langs) > 1 else 1):
        chosen = []
        for k in rng.integers(0, len(langs), BATCH):
            text = texts[k][rng.integers(0, len(texts[k]))]
            at = rng.integers(0, max(1, len(text) - WINDOW))
            chosen.append((text[at : at + WINDOW], k))
        chosen.sort(key=lambda c: -len(c[0]))
        x, reach = side_by_side([c[0] for c in chosen])
        _, g = gradients(p, x, reach, np.array([c[1] for c in chosen]))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return langs, p


def pool(p: dict, texts: pa.Array) -> np.ndarray:
    """Mean probabilities over all bytes of each text."""
    out = np.zeros((len(texts), len(p["ob"])), np.float64)
    waiting: list[tuple[int, int, int, bytes]] = []  # text, bytes before the span, bytes of the span, row

    def read(rows: list[tuple[int, int, int, bytes]]) -> None:
        rows.sort(key=lambda r: -len(r[3]))
        x, reach = side_by_side([r[3] for r in rows])
        lead, size = (np.array([r[i] for r in rows])[None, :] for i in (1, 2))
        sums = np.zeros((out.shape[1], len(rows)))
        for t, q in labels(p, x, reach):
            place = np.arange(t, t + q.shape[1])[:, None]
            sums += np.einsum("ctr,tr->cr", q, ((place >= lead) & (place < lead + size)).astype(q.dtype))
        np.add.at(out, [r[0] for r in rows], sums.T)

    for i, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        for at in range(0, len(raw), SPAN):
            lead = min(at, CONTEXT)
            waiting.append((i, lead, min(SPAN, len(raw) - at), raw[at - lead : at + SPAN + CONTEXT]))
            if len(waiting) == 4 * ROWS:
                waiting.sort(key=lambda r: -len(r[3]))  # rows of one length share a matrix
                for j in range(0, 4 * ROWS, ROWS):
                    read(waiting[j : j + ROWS])
                waiting.clear()
    waiting.sort(key=lambda r: -len(r[3]))
    for j in range(0, len(waiting), ROWS):
        read(waiting[j : j + ROWS])
    return out / np.maximum(out.sum(1, keepdims=True), 1e-30)


def _labelled(batches: Iterator[pa.RecordBatch], text: int, langs: list[str], p: dict) -> Iterator[pa.RecordBatch]:
    free()
    for batch in batches:
        pooled = pool(p, batch.column(text))
        best = pooled.argmax(1) if len(pooled) else np.zeros(0, int)
        arrays = [pa.array([langs[k] for k in best], pa.string()), pa.array(np.minimum(pooled.max(1), 1.0) if len(pooled) else [], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "lang_pred", "score"])


def label(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """`docs` with lang_pred and score, by a network trained on `learn_from` (`docs` if none is given)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    langs, p = train(sample(learn_from or docs))
    unknown = F.col("text").isNull() | ~F.col("text").rlike(LETTER)
    if not langs:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(lambda it: _labelled(it, text, langs, p), schema)
    return out.withColumns({"lang_pred": F.when(unknown, F.lit(UNKNOWN)).otherwise(F.col("lang_pred")), "score": F.when(unknown, F.lit(0.0)).otherwise(F.col("score"))})


def _starts(length: int, size: int, pieces: int | None) -> Iterable[int]:
    """Where the pieces of that many bytes begin: so many at evenly spaced places, or all that it takes to hold every byte."""
    if length < size:
        return ()
    if pieces is None:
        return chain(range(0, length - size, size), (length - size,))
    return sorted({(length - size) * i // pieces for i in range(pieces)})


def _counted(given: Iterable[int], raws: list[bytes], size: int, pieces: int | None) -> Iterator[list[tuple[int, str, int]]]:
    """(language, piece, how often) of pieces that hold a letter; equal pieces have equal scores, so a block has each once."""
    counts, room = defaultdict(Counter), BLOCK
    for k, raw in zip(given, raws):
        for at in batched(_starts(len(raw), size, pieces), max(1, BLOCK // size)):
            counts[k].update(raw[i : i + size] for i in at)
            room -= len(at) * size
            if room <= 0:
                yield _lettered(counts)
                counts, room = defaultdict(Counter), BLOCK
    yield _lettered(counts)


def _lettered(counts: dict[int, Counter]) -> list[tuple[int, str, int]]:
    found = ((k, raw.decode("utf-8", "ignore"), n) for k, c in counts.items() for raw, n in c.items())
    return [x for x in found if any(c.isalpha() for c in x[1])]


def _checked(batches: Iterator[pa.RecordBatch], langs: list[str], p: dict, pieces: int | None) -> Iterator[pa.RecordBatch]:
    """Of batches (lang, text): sums (lang, power, n, s, q) of scores and their squares in units of 1 / UNITS, by the powers of
    two of LENGTHS; those of the power -1 are whole texts, and s has those labelled as they were given."""
    free()
    for batch in batches:
        sums = np.zeros((len(langs), len(LENGTHS) + 1, 3), np.int64)
        given = [langs.index(k) for k in batch.column(0).to_pylist()]
        whole = batch.column(1).to_pylist()
        if not whole:
            continue
        of = np.array(given, int)
        np.add.at(sums[:, -1], of, np.stack((np.ones(len(of), int), pool(p, batch.column(1)).argmax(1) == of, np.zeros(len(of), int)), 1))
        raws = [t.encode("utf-8", "replace") for t in whole]
        for i in LENGTHS:
            for block in _counted(given, raws, 1 << i, pieces):
                if block:
                    of, texts, n = zip(*block)
                    score, n = pool(p, pa.array(texts, pa.string())).max(1), np.array(n, np.int64)
                    units = (np.rint(x * UNITS).astype(np.int64) for x in (score, score**2))
                    np.add.at(sums[:, i], np.array(of), np.stack((n, *(n * u for u in units)), 1))
        rows = [(k, i if i < len(LENGTHS) else -1, *map(int, sums[j, i])) for j, k in enumerate(langs) for i in range(len(LENGTHS) + 1) if sums[j, i, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), *[pa.int64()] * 3))], ["lang", "power", "n", "s", "q"])


def least_scores(docs: DataFrame, langs: list[str], p: dict, pieces: int | None = PIECES) -> np.ndarray | None:
    """From which score a text of 2 ** i bytes or more is recognised, for each i of LENGTHS, by all held-out documents and so many
    `pieces` of each length from each of them, or (None) all pieces, one after the other; None if scores decide nothing."""
    if len(langs) < 2:
        return None
    small_batches(docs.sparkSession)
    held = docs.filter(F.col("lang").isin(langs) & F.col("text").rlike(LETTER) & held_out(F.col("doc_id"))).select("lang", "text")
    each = held.mapInArrow(lambda it: _checked(it, langs, p, pieces), "lang string, power int, n long, s long, q long")
    sums = each.groupBy("lang", "power").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "s", "q"))).collect()  # a few rows per language
    checked = {r["lang"]: int(r["n"]) for r in sums if r["power"] < 0}
    if sum(checked.values()) < LEAST_CHECKED:
        return None
    most = min(SAMPLE_DOCS, max(1, SAMPLE_TOTAL // len(checked)))
    weight = {k: min(1.0, most / n) for k, n in checked.items()}

    def weighed(power: int) -> np.ndarray:
        """Number, sum and sum of squares at that length, with each language's documents at their weight."""
        return np.sum([[weight[r["lang"]] * int(r[c]) for c in ("n", "s", "q")] for r in sorted(sums, key=lambda r: r["lang"]) if r["power"] == power] or [[0.0] * 3], 0)

    n, right, _ = weighed(-1)
    if right / n < LEAST_RIGHT:
        return None
    even = 1 / len(langs)
    return np.array([min(even + LEAST_SHARE * (1 - even), _usual(*weighed(i))) for i in LENGTHS])


def _usual(n: float, s: float, q: float) -> float:
    """The low end of scores by their number, sum and sum of squares; 0 if there are none."""
    if not n:
        return 0.0
    mean = s / n / UNITS
    return mean - SPREADS * max(q / n / UNITS - mean**2, 0.0) ** 0.5


def _recognised(batches: Iterator[pa.RecordBatch], text: int, p: dict, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    free()
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            power = np.minimum(np.log2(np.maximum(size, 1)).astype(int), LENGTHS[-1])
            yield batch.filter(pa.array(pool(p, batch.column(text)).max(1) >= least[power]))


def recognised(docs: DataFrame) -> DataFrame:
    """The rows with a letter that are recognised by the score that their length asks for, by a network trained on `docs`."""
    small_batches(docs.sparkSession)
    letters = docs.filter(F.col("text").rlike(LETTER))
    langs, p = train(sample(docs))
    if (least := least_scores(docs, langs, p, pieces=None)) is None:
        return letters
    text = docs.columns.index("text")
    return letters.mapInArrow(lambda it: _recognised(it, text, p, least), docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document."""
    out = label(docs.select("doc_id", "text"), docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
