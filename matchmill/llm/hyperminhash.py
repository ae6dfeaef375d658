"""Near-duplicate documents by HyperMinHash sketches, banding, and confirmation on full shingle sets.

1. Each document's set of word shingles is sketched: a bucket keeps the leading-zero count of its least hash and the
   mantissa bits after it. Empty buckets borrow from others in a fixed random order.
2. Documents with equal sets are one class from here on, so copies cost one row.
3. Four 16-bit registers make a band of 64 bits. In each band bucket every class is paired with the smallest one there,
   estimated (matches less the expected register collisions), and confirmed on the full sets.
4. Confirmed pairs give components. Members of buckets that still hold several components are paired across components
   by an exact prefix filter on their full sets; those pairs are estimated and confirmed too, and the components are final.

No pairs inside one component are made in step 4, so a large family of copies costs a multiple of its size. At a
similarity of 0.8 a pair shares none of the 32 bands with a probability of about 5e-8.

Defined cases: null or empty texts and texts without words have the empty set and stand alone; with fewer words than a
shingle the whole sequence is the one shingle; a null doc_id stands alone; rows that repeat a doc_id are one document;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, numbered, small_batches, unused, written
from .words import Words, mix, passes
from .workers import free

BUCKETS, MANTISSA_BITS, BAND_REGISTERS = 128, 10, 4
BANDS = BUCKETS // BAND_REGISTERS
#: Pairs whose estimate falls short of the threshold by more than so many standard deviations aren't confirmed.
SLACK_SIGMAS = 5.0
#: Fixed value: the constant in the expected number of register collisions of two HyperMinHash sketches.
COLLISION_CONSTANT = 0.169919487159739093975315012348

#: How many holders of a shingle one task compares with those that are looked up.
HOLDERS = 512

#: Size of the bitmap by which the texts of candidates are picked out, a prime below 2^23; it is broadcast, 1 MB at all sizes.
MARKS = 8388593

#: For each bucket an order in which it looks for a full bucket when it is empty.
BORROW = np.argsort(np.random.default_rng(77).random((BUCKETS, BUCKETS)), axis=1).T


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the text of each."""
    h = words.hashes()
    got, at = words.windows(k, h)
    text = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < k))
    if len(short):
        whole = np.array([mix(np.array([sum((int(x) * (2 * j + 3) for j, x in enumerate(h[words.first[d] : words.first[d + 1]])), 1) % (1 << 64)], np.uint64))[0] for d in short], np.uint64)
        got, text = np.concatenate((got, whole)), np.concatenate((text, short))
    order = np.lexsort((got, text))
    got, text = got[order], text[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (text[1:] != text[:-1])
    return got[new], text[new]


def sketch(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """n rows of registers: leading zeros of the least hash of each bucket, then the bits after its first one."""
    none = np.uint64((1 << 64) - 1)
    least = np.full((n, BUCKETS), none)
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    value = hashes & np.uint64((1 << 57) - 1)
    np.minimum.at(least.reshape(-1), text * BUCKETS + bucket, value)
    empty = least == none
    _, e = np.frexp(np.where(empty, np.uint64(1), np.maximum(least, np.uint64(1))).astype(np.float64))
    zeros = 57 - np.minimum(e, 57)
    bits = np.maximum(57 - zeros - 1, 0).astype(np.int64)
    shifted = np.where(bits > MANTISSA_BITS, least >> np.maximum(bits - MANTISSA_BITS, 0).astype(np.uint64), least << np.maximum(MANTISSA_BITS - bits, 0).astype(np.uint64))
    regs = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | (shifted & np.uint64((1 << MANTISSA_BITS) - 1))
    full = ~empty
    rows = np.flatnonzero(empty.any(1) & full.any(1))
    for step in BORROW:
        if not len(rows):
            break
        fill = empty[rows] & full[rows][:, step]
        r, b = np.nonzero(fill)
        regs[rows[r], b] = regs[rows[r], step[b]]
        empty[rows[r], b] = False
        rows = rows[empty[rows].any(1)]
    return regs


def bands_of(regs: np.ndarray) -> np.ndarray:
    """Four registers make one signed 64-bit number."""
    r = regs.reshape(len(regs), BANDS, BAND_REGISTERS)
    key = np.zeros(r.shape[:2], np.uint64)
    for j in range(BAND_REGISTERS):
        key = (key << np.uint64(16)) | r[:, :, j]
    return key.view(np.int64)


SKETCH = "doc_id long, n long, s1 long, s2 long, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    free()
    for batch in batches:
        ids = batch.column(0)
        for i, words in passes(batch.column(1), lower=True):
            n = len(words.first) - 1
            h, text = shingle_sets(words, k)
            size = np.bincount(text, minlength=n)
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(s1, text, h)
            np.add.at(s2, text, mix(h ^ np.uint64(0x5DEECE66D)))
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(sketch(h, text, n)).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), bands], ["doc_id", "n", "s1", "s2", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, words in passes(batch.column(1), lower=True):
            n = len(words.first) - 1
            h, text = shingle_sets(words, k)
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), lists], ["doc_id", "shingles"])


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the places of `ids` (doc_id), gathered in at most MARKS / 64 + 1 rows."""
    place = F.pmod("doc_id", F.lit(MARKS))
    rows = ids.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, int(pmod(doc_id, {MARKS}) & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    marks = np.zeros(MARKS // 64 + 1, np.uint64)
    marks[[r["w"] for r in rows]] = np.array([r["b"] for r in rows], np.int64).view(np.uint64)
    return marks


def _sets_of(texts: DataFrame, ids: DataFrame, k: int, label: str) -> DataFrame:
    """Written (doc_id, shingles) of the documents in `ids` and some others. Their texts are picked out where they are
    read, so no text is shuffled; what the bitmap lets through too much no later join finds."""
    marks = texts.sparkSession.sparkContext.broadcast(_marked(ids))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False) % MARKS
            hit = (marks.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(hit.astype(bool)))
            if some.num_rows:
                yield some

    return written(texts.mapInArrow(lambda it: _full_sets(chosen(it), k), "doc_id long, shingles array<long>"), label)


def registers(bands: np.ndarray) -> np.ndarray:
    u = bands.view(np.uint64)
    return np.stack([(u >> np.uint64(16 * (BAND_REGISTERS - 1 - j))) & np.uint64(0xFFFF) for j in range(BAND_REGISTERS)], -1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two arrays of bands: matching registers less those expected to collide by chance."""
    same = (registers(a) == registers(b)).reshape(len(a), -1).sum(1) / BUCKETS
    r = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    by_chance = COLLISION_CONSTANT * 4 * r / (1 + r) ** 2 / (1 << MANTISSA_BITS)
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m, x, y = batch.columns
        n, m = n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False)
        x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(n), BANDS) for c in (x, y))
        sigma = np.sqrt(least * (1 - least) / np.minimum(BUCKETS, np.minimum(n, m)))
        keep = pa.array(estimate(x, y, n, m) >= least - SLACK_SIGMAS * sigma)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. Sizes that can't meet it and low estimates go first."""
    side = lambda s: reps.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("bands").alias(f"bands{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    likely = both.select("a", "b", "na", "nb", "bandsa", "bandsb").mapInArrow(lambda it: _likely(it, percent / 100), "a long, b long")
    likely = written(likely, f"{label}-likely")
    wanted = likely.select("a").union(likely.select("b")).toDF("doc_id").distinct()
    written_sets = _sets_of(texts, wanted, k, f"{label}-sets")
    sets = written_sets.dropDuplicates(["doc_id"])
    of = lambda s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set{s}"))
    common = F.size(F.array_intersect("seta", "setb"))
    pairs = likely.join(of("b"), "b").join(of("a"), "a").filter(common * 100 >= (F.size("seta") + F.size("setb") - common) * percent)
    links = written(pairs.select("a", "b"), f"{label}-links")
    discard(likely, written_sets)
    return links


def _across(mixed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `mixed` (id, component) in different components that may be linked; no linked pair is missing.

    Shingles are ordered from rare to frequent. Linked documents of sizes n and m have percent / (100 + percent) * (n + m)
    of them in common, so the first that they share stands early in both: what comes after it has to be enough. Each
    document is looked up by the shingles that stand early enough, and a shingle's largest component isn't paired with
    itself. The holders of a frequent shingle are dealt to parts of about HOLDERS, so no task compares all of them; texts
    that share a long template but stay under the threshold still cost a comparison each pair, spread over the parts."""
    ids = mixed.select("id", "component").distinct()
    wanted = ids.select(F.col("id").alias("doc_id"))
    written_sets = _sets_of(texts, wanted, k, "mixed-sets")
    sets = written_sets.dropDuplicates(["doc_id"]).join(wanted, "doc_id", "left_semi")
    each = sets.select(F.col("doc_id").alias("id"), F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    common = each.join(held, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("common"))
    early = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("common"))
    keys = common.withColumn("before", F.col("n") - F.size("common")).select("id", "n", "before", F.posexplode(F.slice("common", 1, F.greatest(early, F.lit(0)).cast("int"))).alias("at", "c"))
    keys = keys.select("id", (F.col("n") - F.col("before") - F.col("at")).alias("left"), "n", F.col("c.shingle").alias("shingle")).join(ids, "id")
    keys = written(keys, "early-shingles")
    discard(written_sets)
    sizes = keys.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("holders"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    keys = keys.join(main.select("shingle", "holders", F.col("top.component").alias("main")), "shingle")
    side = lambda v: [F.col("id").alias(v), F.col("component").alias(f"c{v}"), F.col("n").alias(f"n{v}"), F.col("left").alias(f"l{v}")]
    parts = F.ceil(F.col("holders") / HOLDERS).cast("int")
    rest = keys.filter("component <> main").select("shingle", *side("x"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    held = keys.select("shingle", *side("y"), (F.col("component") == F.col("main")).alias("of_main"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    pairs = rest.join(held, ["shingle", "part"])
    pairs = pairs.filter(f"cx <> cy AND (of_main OR x < y) AND {100 + percent} * least(lx, ly) >= {percent} * (nx + ny) AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`, linked at 100 * intersection >= percent * union.

    percent is best at 70 or more: below that pairs share too few bands of four registers."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(texts.mapInArrow(lambda it: _sketches(it, k), SKETCH), "sketches")
    key = ["n", "s1", "s2"]
    classes = seen.filter("doc_id IS NOT NULL AND n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    able = F.col("n") * 100 >= (F.col("n") + 1) * percent  # a smaller set is linked with no other set but its equals
    reps = classes.filter(able).select(F.col("rep").alias("doc_id"), "n", "bands")
    members = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    first = members.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    crowded = written(members.join(first, ["band", "key"]).withColumnRenamed("doc_id", "b"), "crowded")
    links = _confirmed(crowded.filter("a <> b").select("a", "b").distinct(), reps, texts, k, percent, "star")
    found = written(components(links), "components")
    labelled = crowded.select("band", "key", F.col("b").alias("id")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    mixed = written(labelled.join(main.select("band", "key", F.col("top.component").alias("main")), ["band", "key"]), "mixed")
    across = _across(mixed, texts, k, percent)
    more = _confirmed(across.join(crowded.filter("a <> b").select("a", "b").distinct(), ["a", "b"], "left_anti"), reps, texts, k, percent, "cross")
    if not more.isEmpty():
        found = components(links.union(more))
    discard(crowded, mixed, links, more)
    named = classes.select(*key, "rep", "copies").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.filter("copies > 1 OR component IS NOT NULL").select(*key, F.coalesce("component", "rep").alias("component"))
    out = seen.filter("doc_id IS NOT NULL AND n > 0").join(named, key, "left").unionByName(seen.filter("doc_id IS NULL OR n = 0"), allowMissingColumns=True)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the rows that near_duplicates() doesn't keep, judged row by row: what the rows share is never their
    doc_id but their text, so one that repeats the doc_id of another with other words stays, as do null doc_ids and
    texts without words, and of rows linked to each other the one with the smallest doc_id stays.

    Where ids repeat or are null, rows are numbered in the order of (doc_id, text); elsewhere the doc_id is the number."""
    columns, row = docs.columns, unused(docs, "row")
    rows = numbered(docs, row, "near-numbered", F.col("doc_id").asc_nulls_last(), F.col("text"))
    judged = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), k, percent)
    dropped = written(judged.filter("NOT kept").select(F.col("doc_id").alias(row)), "near-dropped")
    return rows.join(dropped, row, "left_anti").select(*columns)
