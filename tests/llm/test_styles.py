"""The other operators and the pipeline against plain Python, the libraries, or held-out labels."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchmill.llm import components, htmltext, hyperminhash, langid, mixing, packing, substring, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, anchors string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(400)]
BASE = " ".join(rng.choice(VOCABULARY, 120))
PASSAGE = " ".join(rng.choice(VOCABULARY, 30))


def edited(t, n):
    w = t.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"e{rng.integers(10**6)}"
    return " ".join(w)


TEXTS = [None, "", " \n", "One two", "one  two", "one two three four", BASE, BASE, BASE.upper(), *(edited(BASE, n) for n in (1, 2, 3, 4, 6, 8)), f"a b {PASSAGE} c", f"x {PASSAGE}\ny {PASSAGE}", "é \U0001f600 don't  stop <|endoftext|> 12345", "z" * 3000, "q " * 3000, *(" ".join(rng.choice(VOCABULARY, 60)) for _ in range(8))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "b", "a", "c")[i % 4], None, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (6, TEXTS[6], "en", "c", 1, "x", "y", "z"), (None, BASE, None, None, None, "x", "y", "z")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, none):
    first = {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = substring.digest(docs).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        w = WORD.findall((BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]) or "")
        gone = {x for j in range(len(w) - 12) if r["doc_id"] is not None and first[tuple(w[j : j + 13])] < r["doc_id"] for x in range(j, j + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.digest(none).count() == 0


def test_near(docs, none):
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [shingles(t) for t in TEXTS]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    for r in hyperminhash.near_duplicates(docs).collect():
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert hyperminhash.near_duplicates(none).count() == 0


def test_near_of_few_shingles(spark):
    """Sets of four and five shingles are linked at exactly 80 of 100; smaller ones only with their equals."""
    texts = {1: "a b c d e f g h", 2: "a b c d e f g", 3: "a b c d e f", 4: "p q r", 5: "P  q\nr", 6: "a b c d e f g", 7: "p q r s", 8: ""}
    got = hyperminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {1: (5, 1), 2: (4, 1), 3: (3, 3), 4: (1, 4), 5: (1, 4), 6: (4, 1), 7: (1, 7), 8: (0, 8)}


def test_estimates():
    """Sketches of sets with known similarity."""
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * share / (1 + share) * 2)
        a, b = h[:2000], h[2000 - n : 4000 - n]
        regs = hyperminhash.sketch(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
        k = hyperminhash.bands_of(regs)
        got = hyperminhash.estimate(k[:1], k[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - n / (len(a) + len(b) - n)) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 70), (100, 100)]
    out = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 50, 50: 50, 70: 50}


def test_mixing(docs, none):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and sorted(map(repr, rows)) == sorted(map(repr, mixing.taken(docs.repartition(5)).collect()))
    sizes, got = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        sizes[key], got[key] = sizes.get(key, 0) + r["size"], got.get(key, 0) + r["taken"]
    total = sum(sizes.values())
    assert abs(sum(t for _, t in sizes) - 1.5 * total) < 1e-6 * total
    assert all(s == k[0] and k[1] <= 2 * s and abs(got[k] - k[1]) <= 1 for k, s in sizes.items())
    n = mixing.mix(docs.drop("row")).select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert n == sum(got.values()) and mixing.taken(none).count() == 0


def test_quota_tree():
    counts = rng.integers(0, 50, 21)
    q = mixing.split_quota(counts, 200, (7,))
    assert q.sum() == 200 and (q <= counts).all() and (q == mixing.split_quota(counts, 200, (7,))).all()


def test_tokens(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokencount.vocabulary("byte_bpe_50k.json"))
    for r in tokencount.token_counts(docs).collect():
        t = (BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]) or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    counts = tokencount.counts_for(tokencount.vocabulary("byte_bpe_50k.json"))
    pool = list("abthe T's\n\t\r\x1c\x85\xa0　é́日9²!") + ["<|endoftext|>", "  ", "ll"]
    for _ in range(400):
        t = "".join(rng.choice(pool, rng.integers(0, 15)))
        assert tokencount.count_text(t, counts, chunk=3) == tokencount.count_text(t, counts) == len(library.encode(t, add_special_tokens=False).ids)
    assert tokencount.token_counts(none).count() == 0


def pack_length(library, t):
    return len(library.encode(t, add_special_tokens=False).ids) + 1


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokencount.vocabulary("word_bpe_49k.json"))
    rows = packing.pack(docs.filter("doc_id <> 6 OR doc_id IS NULL")).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in packing.pack(docs.filter("doc_id = 6")).collect()) == 2 * pack_length(library, TEXTS[6])
    for i, t in [*enumerate(TEXTS), (None, BASE)]:
        if i == 6:
            continue
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(none).count() == 0
    cube = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert(cube, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cube[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_ids_of_odd_texts():
    """Texts of Latin, other and white-space code points, special strings and contractions against the library."""
    import random

    words = packing.WordIds(tokencount.vocabulary("word_bpe_49k.json"))
    draw = random.Random(5)
    odd = list("abcDEFß'ÀÉ ²1½29.,-_\t\n'sT'LLl'ré\xa0\xadа中\x1c\x85İ")
    texts = ["".join(draw.choices(odd, k=draw.randrange(40))) for _ in range(3000)]
    texts += [f"a {s}b" for s in words.special] + [f"x{s.upper()}y" for s in words.special]
    for text in texts:
        assert list(np.frombuffer(words.text(text), "<u2")) == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_language_gradients():
    p = {k: v.astype(np.float64) for k, v in langid.initial(3).items()}
    x, reach = langid.side_by_side([b"a long row of bytes", b"hello", b"x"])
    y = np.array([0, 1, 2])
    _, g = langid.gradients(p, x, reach, y)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        assert abs(g[k][i] - (langid.gradients(up, x, reach, y)[0] - langid.gradients(down, x, reach, y)[0]) / 2e-4) < 1e-3


def test_language_pooling():
    """Pooled probabilities against the network read byte by byte over the whole text: equal up to one span, near beyond."""
    import pyarrow as pa

    p = langid.initial(3, seed=4)

    def plain(text):
        def states(d, raw):
            h, out = np.zeros(langid.HIDDEN), []
            for byte in raw:
                a, b = p[f"{d}x"][byte] + p[f"{d}c"], h @ p[f"{d}h"]
                curve = lambda v: v / (1 + abs(v))
                k = langid.HIDDEN
                z, r = (0.5 + 0.5 * curve(a[i * k : i * k + k] + b[i * k : i * k + k]) for i in (0, 1))
                n = curve(a[2 * k :] + r * b[2 * k :])
                h = n + z * (h - n)
                out.append(h)
            return out

        raw = text.encode()
        both = [np.concatenate(x) for x in zip(states("f", raw), states("b", raw[::-1])[::-1])]
        q = [np.exp(s @ p["o"] + p["ob"]) for s in both]
        return np.mean([x / x.sum() for x in q], 0)

    texts = ["", "hello there", "é\U0001f600", "日本語の文章" * 20, *(" ".join(rng.choice(VOCABULARY, n)) for n in (20, 60, 500))]
    got = langid.pool(p, pa.array([*texts, None]))
    for t, g in zip(texts, got):
        if t:
            assert np.abs(g - plain(t)).max() < (1e-5 if len(t.encode()) <= langid.SPAN else 5e-3)
    assert not got[0].any() and not got[-1].any()


def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.digest(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.count()
    got = {r["doc_id"]: r for r in langid.digest(docs.filter("doc_id IS NOT NULL")).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[6]["lang_pred"] in ("en", "de")
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    assert langid.digest(none).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One <b>two.<p>Three\n four.<br>Five</article><div id=comments>no</div><footer>f</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "plain <p text"), (4, "x", "<p>" * 2000 + "deep")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in htmltext.extract(rows).collect()}
    assert out[1]["text"] == "A & B\nOne two.\nThree four.\nFive" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[None]["text"] == "" and out[4]["text"] == "deep"
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_html_paths():
    """Scores of paths choose the content, whatever holds it."""
    long = "Long running text of the page, with commas, and more. " * 6
    div = f"<div><h1>Head</h1><div>By me</div><p>{long}</p><ul><li>one</li><li>two</li></ul><p>{long}</p></div>"
    teaser = "<article><h2>Related</h2><p>A teaser, of some words.</p></article>"
    want = ["Head", long.strip(), "one", "two", long.strip()]
    got = htmltext.main_text(f"<nav><a>Home</a></nav>{div}{teaser}<footer>f</footer>").split("\n")
    assert [x for x in got if x != "By me"] == want
    inner = htmltext.main_text(f"<article><h1>Head</h1>{f'<p>{long}</p>' * 5}<div><a>tag</a></div><div><a>tag</a></div></article>").split("\n")
    assert inner == ["Head", *[long.strip()] * 5]


def test_html_names():
    """Names lower a score as whole words, do not veto what holds most of the text, and a closed svg is empty."""
    long = "Long running text of the page, with commas, and more. " * 6
    article = f'<article><div class="entry-header"><h1>Head</h1></div><p>{long}</p></article>'
    want = f"Head\n{long.strip()}"
    for around in ('div class="layout has-sidebar"', 'div class="no-banner"', 'section class="social-science"', 'div class="sidebar"', "form", "footer"):
        assert htmltext.main_text(f"<{around}>{article}</{around.split()[0]}><div class='wide ad'>Buy now.</div>") == want
    svg = f"<article><p>{long}</p><svg class='x' title='a>b'/><p>{long}</p><svg><title>no</title></svg><svg/><p>{long}</p></article>"
    assert htmltext.main_text(svg) == "\n".join([long.strip()] * 3)


def test_pipeline_language(spark):
    """The network's score rejects what is of no one language and no clean document; with nothing learned letters decide."""
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = table.filter("length(text) > 2000").groupBy("lang").agg(F.sort_array(F.collect_list("text")).alias("t")).collect()
    mixed = [(10**6 + i, " ".join(r["t"][i % len(r["t"])][:2000] for r in long), None, "j", 1) for i in range(5)]
    short = [(10**6 - 1, "Of and and ly esor.\nLicensed under the Apache License, Version 2.0.", "en", "j", 67)]
    table = table.unionByName(spark.createDataFrame(short, table.schema))
    docs = table.unionByName(spark.createDataFrame(mixed, table.schema))
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    clean, letters = (ids(d.filter(F.col("text").rlike(r"\p{L}"))) for d in (table, docs))
    assert ids(corpus_pipeline.language(spark, docs, "")) == clean and len(letters) == len(clean) + 5
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    held = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.col("lang")))
    assert ids(corpus_pipeline.language(spark, unlabelled, "")) == ids(corpus_pipeline.language(spark, held, "")) == letters


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    path = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL").write.parquet(f"{path}/documents.parquet")
    stage = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = stage.columns, []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, path)
        assert stage.columns == columns
        seen.append({r["doc_id"] for r in stage.collect()})
    letters = {i for i, t in enumerate(TEXTS) if t and re.search(r"[^\W\d_]", t)}
    best = {}
    for i in sorted(letters, key=lambda i: (-len(TEXTS[i]), i)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", TEXTS[i]), i)
    assert seen[0] == letters and seen[1] == set(best.values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i in seen[1] if (w := WORD.findall(TEXTS[i].lower()))}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert seen[2] == {i for i in root if root[i] == i} and seen[3] <= seen[2]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == seen[3]


def test_html_unclosed():
    """An unclosed raw element other than a script or style loses nothing that follows; many of them cost no more each."""
    long = "Long running text of the page, with commas, and more. " * 6
    for tag in ("svg", "title", "select", "noscript", "template"):
        assert htmltext.main_text(f"<{tag}><article><h1>Head</h1><p>{long}</p></article>") == f"Head\n{long.strip()}"
    assert htmltext.main_text(f"<article><p>{long}</p></article><script>var a = '<p>no</p>';") == long.strip()
    assert long.strip() in htmltext.main_text("<svg>" * 20000 + f"<article><p>{long}</p></article>")


def test_html_rows(spark):
    """Repeated rows, clashing columns and a very long page."""
    page = "<article>" + "<p>Some text of the page, and more of it.</p>" * 20000 + "</article>"
    rows = spark.createDataFrame([(1, "u", page, "x", 5), (1, "u", page, "y", 6)], "page_id long, url string, html string, text string, n_chars long")
    out = htmltext.extract(rows).collect()
    assert [r["text"].count("\n") for r in out] == [19999] * 2 and out[0] == out[1]


def test_hypergeometric():
    """The own sampler follows numpy's law where numpy has one, and the exact moments beyond."""
    r = np.random.default_rng(3)
    for left, right, q in ((50, 70, 30), (5000, 300, 1000), (10, 10, 19), (3, 10**5, 50000)):
        want = r.hypergeometric(left, right, q, 20000)
        limit, mixing.NUMPY_DRAWS = mixing.NUMPY_DRAWS, 0
        got = np.array([mixing.hypergeometric(r, left, right, q) for _ in range(20000)])
        mixing.NUMPY_DRAWS = limit
        values = np.unique(np.concatenate((want, got)))
        a, b = (np.array([(x <= v).mean() for v in values]) for x in (want, got))
        assert np.abs(a - b).max() < 0.02
    big = np.array([mixing.hypergeometric(r, 3 * 10**13, 10**13, 10**13) for _ in range(2000)], float)
    sd = (1e13 * 0.75 * 0.25 * 0.75) ** 0.5
    assert abs(big.mean() - 7.5e12) < 5 * sd / 2000**0.5 and abs(big.std() / sd - 1) < 0.1


def test_quota_levels(spark):
    """Quotas of three thousand shards, split in two levels, add up and fit."""
    rows = [(s, i, 5000, int(rng.integers(1, 9))) for s in (1, -2) for i in range(3000)]
    held = spark.createDataFrame(rows, "source_key long, shard int, quota long, words long")
    got = {(r["source_key"], r["shard"]): r["shard_quota"] for r in mixing.quotas_of(held, 4096).collect()}
    words = {(s, i): w for s, i, _, w in rows}
    assert got.keys() == words.keys() and all(0 <= got[k] <= words[k] for k in got)
    assert all(sum(v for k, v in got.items() if k[0] == s) == 5000 for s in (1, -2))


def test_rows_that_share_an_id(spark):
    """Exact and near dedup drop rows, not ids."""
    from matchmill.llm import blocknames

    rows = [(3, "hello a", "x"), (5, "hello a", "y"), (5, "unique b", "z"), (None, "hello  a", "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted((r["text"] or "", r["row"]) for r in blocknames.deduplicated(docs).collect())
    assert [t for t, _ in kept] == ["", "hello  a", "unique b"]  # the longest of the equal ones
    near = [(1, BASE, "a"), (2, BASE, "b"), (2, "other words of its own", "c"), (None, BASE, "d"), (None, "", "e")]
    got = hyperminhash.deduplicated(spark.createDataFrame(near, "doc_id long, text string, row string")).collect()
    assert sorted(r["row"] for r in got) == ["a", "c", "e"]


def test_mix_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 50, "s", "r", "f", i) for i in range(8)], "doc_id long, text string, source string, row string, full string, drawn long")
    out = mixing.mix(docs)
    assert out.columns == docs.columns and all((r["row"], r["full"], r["drawn"]) == ("r", "f", r["doc_id"]) for r in out.collect())


def test_html_ratios(monkeypatch):
    """The ratios choose the content: without the factors of tags and names more than nine pages of ten stay as they are."""
    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    want = [htmltext.main_text(p) for p in pages]
    articles = [re.search(r"<article>(.*?)</article>", p, re.S)[1] for p in pages]
    assert all(re.sub(r"\s", "", w) == re.sub(r"\s", "", htmltext.main_text(f"<article>{a}</article>")) for w, a in zip(want, articles))
    monkeypatch.setattr(htmltext, "LOWERED", 1.0)
    monkeypatch.setattr(htmltext, "RAISED", 1.0)
    monkeypatch.setattr(htmltext, "BOILERPLATE", frozenset())
    monkeypatch.setattr(htmltext, "NAMES", frozenset())
    assert sum(htmltext.main_text(p) == w for p, w in zip(pages, want)) > 0.9 * len(pages)


def test_html_contract():
    """What belongs to the article and what doesn't."""
    long = "Long running text of the page, with commas, and more. " * 6
    p = lambda n: f"<p>{long}</p>" * n
    cases = {
        f"<article><h1>T</h1>{p(3)}<h2>Needs</h2><ul><li>eggs</li><li>milk</li></ul></article>": "T L L L Needs eggs milk",
        f"<article><h1>T</h1>{p(3)}<table><tr><td>a</td><td>b</td></tr></table></article>": "T L L L a b",
        f'<article>{p(3)}</article><div class="comments-area"><div class="comment-body"><p>I liked this, very much.</p></div></div>': "L L L",
        f'<article>{p(1)}</article><div class="comments"><h3>Comments</h3>{p(40)}</div>': "L",
        f'<div class="cookie-notice">We use cookies, as you know.</div><article>{p(2)}</article><div class="related-posts"><h3>More</h3><p>Teaser one, read.</p></div>': "L L",
        f"<article>{p(2)}</article><div>Subscribe to our newsletter today, and get news.</div><div>Copyright 2024 Someone, all rights reserved.</div>": "L L",
        f"<div><ul><li><a>Home</a></li><li><a>About</a></li></ul></div><div id=content><h1>T</h1>{p(3)}<ul><li>point</li></ul><ul><li><a>tag</a></li></ul></div>": "T L L L point",
        f"<main><h1>T</h1><p>Lead.</p><section><h2>One</h2>{p(2)}</section><section><h2>Two</h2>{p(2)}<blockquote><p>Quote.</p></blockquote></section></main>": "T Lead. One L L Two L L Quote.",
    }
    for page, want in cases.items():
        assert htmltext.main_text(page).replace(long.strip(), "L").split("\n") == want.split(" "), page


def test_substring_shared_ids(spark):
    """Rows that share a doc_id lose words only where they hold the repeat themselves."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(15)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, f"{c} {a}"), (3, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove(docs).collect())
    assert got == [(1, 15, 0, a), (2, 15, 0, b), (2, 15, 15, ""), (2, 30, 15, c), (3, 15, 15, "")]
    spans = sorted((r["doc_id"], r["first"], r["n_words"]) for r in substring.maximal_repeats(docs).collect())
    assert spans == [(2, 0, 15), (2, 15, 15), (3, 0, 15)]


def test_language_lengths(spark):
    """The score that a text must have follows its length, and no clean text of any length falls below it."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, p = langid.train(langid.sample(table))
    least = langid.least_scores(table, langs, p)
    assert len(least) == len(langid.LENGTHS) and (least <= 0.325 + 1e-9).all() and (least[8:] > 0.3).all()
    texts = [r["text"] for r in table.filter("length(text) > 3000").orderBy("doc_id").limit(60).collect()]
    for size in (3, 20, 100, 255, 256, 1000, 3000):
        docs = spark.createDataFrame([(i, t[:size], "x") for i, t in enumerate(texts)], "doc_id long, text string, best string")
        kept = sum(b.num_rows for b in langid._recognised(iter(docs.toArrow().to_batches()), 1, p, least))
        assert kept >= len(texts) - 1, size


def test_language_thresholds_from_all(spark, monkeypatch):
    """The least scores come from every held-out document, whatever the size of the sample, each language at its weight."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    langs, p = langid.train(langid.sample(table), steps=30)
    for name, value in (("SAMPLE_DOCS", 10), ("LEAST_RIGHT", 0.0), ("LEAST_SHARE", 9.0)):
        monkeypatch.setattr(langid, name, value)
    least = langid.least_scores(table, langs, p)
    rows = table.filter(langid.held_out(table["doc_id"]) & table["lang"].isNotNull() & table["text"].rlike(langid.LETTER)).select("lang", "text").collect()
    counts = {k: sum(r["lang"] == k for r in rows) for k in langs}
    assert min(counts.values()) > 10
    for i in (5, 9):
        pieces = []
        for r in rows:
            raw, n = r["text"].encode(), 1 << i
            for at in sorted({(len(raw) - n) * j // langid.PIECES for j in range(langid.PIECES)}) if len(raw) >= n else ():
                piece = raw[at : at + n].decode("utf-8", "ignore")
                if any(c.isalpha() for c in piece):
                    pieces.append((10 / counts[r["lang"]], piece))
        w, score = np.array([x[0] for x in pieces]), langid.pool(p, pa.array([x[1] for x in pieces], pa.string())).max(1)
        mean = np.average(score, weights=w)
        assert abs(least[i] - (mean - langid.SPREADS * np.average((score - mean) ** 2, weights=w) ** 0.5)) < 1e-5, i


def test_language_thresholds_from_whole_texts(spark, monkeypatch):
    """The stage's least scores come from every byte of the held-out texts: what lies between a few places of a text counts."""
    rows = [(i, "en" if i % 2 else "de", ("the river of the house and " if i % 2 else "der Fluss und das Haus ist ") * 3) for i in range(300)]
    table = spark.createDataFrame([(i, k, t + "qzx wvk jjq " * 40 + t) for i, k, t in rows], "doc_id long, lang string, text string").repartition(3)
    langs, p = langid.train([(k, t) for _, k, t in rows], steps=30)
    for name, value in (("LEAST_RIGHT", 0.0), ("LEAST_SHARE", 9.0), ("BLOCK", 256)):
        monkeypatch.setattr(langid, name, value)
    seen = {}
    real = langid.least_scores
    monkeypatch.setattr(langid, "least_scores", lambda *a, **k: seen.setdefault("least", real(*a, **k)))
    monkeypatch.setattr(langid, "train", lambda _: (langs, p))
    langid.recognised(table)
    held = [r["text"].encode() for r in table.filter(langid.held_out(table["doc_id"])).collect()]
    for i in (3, 7):
        n = 1 << i
        cut = [raw[at : at + n].decode() for raw in held for at in [*range(0, len(raw) - n, n), len(raw) - n]]
        score = langid.pool(p, pa.array([x for x in cut if any(c.isalpha() for c in x)], pa.string())).max(1)
        assert abs(seen["least"][i] - (score.mean() - langid.SPREADS * score.std())) < 1e-5, i
