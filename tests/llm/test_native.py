"""PII, quality counts and exact dedup against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchmill.llm import blocknames, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, best string, items string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n ", "a@b.co", "x a@b.c_d@e.f, y", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 300.1.2.3 001.2.3.255",
    "é call +1 (743) 555-3824, +12 or +1 2", "5  4111111111111111 9", "\U0001f600 write me@x.org.", "me@x.org " * 300, "IBAN GB82WEST12345698765432 DE00WEST12345698765432",
    "one two three one two three four\nline\nline\n\n\nline", "a b c " * 40, "the cat sat on the mat. " * 30, "x" * 5000, "9" * 5000, "4111 " * 2000, "a b c d e",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None, "x", "y"), (None, " a@b.co", None, None, None, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_pii(docs):
    for r in pii.digest(docs.join(docs.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").withColumn("text", F.col("t"))).collect():
        want = base_spans(TEXTS[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()], TEXTS[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)
    assert pii.digest(docs).count() == len(TEXTS) + 2
    assert [r["spans"] for r in pii.digest(docs.filter("doc_id = 11")).collect()] == ["iban:5:27"]


def test_context_decides(spark):
    """A key or a social security number stays only near a word of its context; every hex token of the table is found."""
    texts = ['an token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "digest 04dbebab91ab85687d33eeaaf9ac699e1188f962", "SSN 123-45-6789", "part 123-45-6789", "SSN 000-45-6789", "IBAN GB82 WEST 1234 5698 7654 32"]
    out = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["spans"] for r in out] == ["secret:12:52", "", "ssn:4:15", "", "", "iban:5:32"]
    assert [r["scores"] for r in out] == ["0.8", "", "0.8", "", "", "1.0"] and [r["n_spans"] for r in out] == [1, 0, 1, 0, 0, 1]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = table.filter(F.lower("text").rlike('token = "[0-9a-f]{40}"'))
    assert tokens.count() == pii.digest(tokens).filter("n_secret > 0").count() > 5
    assert pii.redact(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).first()["text"] == 'an token = "<secret>" x'


def test_redact(docs):
    assert pii.redact(docs.filter("doc_id = 5")).first()["text"] == "card <card> and 4111-1111-1111-1112"


def counted(t):
    w = WORD.findall(t or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(docs):
    for r in quality.digest(docs).collect():
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None else " a@b.co"
        n = counted(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, t
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_em_learns_the_better_rule():
    patterns = [((1, 1, 1), 80), ((-1, -1, -1), 10), ((-1, -1, 1), 10), ((1, 1, -1), 20)]
    _, w = quality.fit(patterns)
    assert w[0][-1] < w[2][-1] and w[2][1] <= w[0][1]


def test_em_by_document():
    """Weights from counted patterns equal EM over single documents."""
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.random(600) < 0.8
    v = np.where(rng.random((600, 4)) < 0.3, 0, np.where(rng.random((600, 4)) < 0.9, 1, -1) * np.where(truth, 1, -1)[:, None])
    prior, weights = quality.fit(list(Counter(map(tuple, v.tolist())).items()), rounds=30)
    good = np.where((v < 0).any(1), 0.05, 0.95)
    for _ in range(30):
        w = {(j, s): np.log((good[v[:, j] == s].sum() + 1) / (good.sum() + 3)) - np.log(((1 - good)[v[:, j] == s].sum() + 1) / ((1 - good).sum() + 3)) for j in range(4) for s in (-1, 1)}
        p = np.log((good.sum() + 1) / ((1 - good).sum() + 1))
        good = 1 / (1 + np.exp(-(p + np.array([sum(w[j, x] for j, x in enumerate(row) if x) for row in v.tolist()]))))
    assert abs(p - prior) < 1e-6 and all(abs(w[j, s] - weights[j][s]) < 1e-6 for j, s in w)
    assert ((good >= 0.5) == truth).mean() > 0.9


def test_quality_verdict(spark):
    """The posterior overrules the base rules' verdict on labelled junk and leaves good documents."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = quality.judge(table).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()
    by = {r["quality"]: r for r in seen}
    assert by[0]["n"] >= 20 and by[0]["kept"] <= 0.1 * by[0]["n"] and by[1]["kept"] >= 0.98 * by[1]["n"]


@pytest.mark.parametrize("how", [{}, {"block_chars": 3}, {"block_chars": 3, "hash_of": lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))}])
def test_exact_dedup(docs, how):
    """The last case puts all items in three buckets, so that every name is settled by sorting."""
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, " a@b.co")]
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = blocknames.groups(docs, **how).collect()
    assert len(out) == len(rows)
    for r in out:
        t = plain(TEXTS[r["doc_id"]] if r["doc_id"] is not None else " a@b.co")
        assert (r["keep_id"], r["group_size"]) == (min(groups[t])[3], len(groups[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert sum(r["kept"] for r in out) == len(groups)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pii.digest(none).count() == quality.digest(none).count() == blocknames.groups(none).count() == 0
