"""Quality by weak supervision: rules vote good or bad or abstain, EM weighs them, the posterior decides.

Each rule looks at counts of one text. The votes of a document form a pattern; there are at most 3^8 patterns, so the
counts of patterns over all documents are a table of bounded size, and EM on it is EM on every document. What goes back
to the documents is a sum of one weight per rule and vote, and that sum alone decides beside the two base rules.

Defined cases: a null or empty text has no words and fails the base rules; with no documents there are no rows; ties in
the posterior (exactly 0.5) keep the document; repeated rows are judged alike; a very long text is one row of counts
like any other; a null doc_id stays null; other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of the four languages.
COMMON = ("the", "and", "of", "to", "in", "is", "that", "for", "le", "la", "de", "et", "les", "des", "que", "der", "die", "und", "das", "ein", "von", "el", "los", "en", "y", "con")
COMMON_WORD = rf"(?i)(?<![^\x20\x09-\x0D])(?:{'|'.join(COMMON)})(?![^\x20\x09-\x0D])"


def counts(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document the counts that rules look at; n_repeat_words are words inside three-word windows that occur twice or more.

    Windows are sorted by (hash, position), so equal windows stand side by side; neighbours are compared word by word."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda l: F.length(F.translate(l, WS, "")) > 0)
    a = docs.select(F.col(id).alias("doc_id"), t.alias("text"))
    a = a.select(
        "doc_id",
        "text",
        F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " ", -1), "").alias("words"),
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZÉÈÄÖÜÑ", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", ".!?", ""))).cast("long").alias("n_stops"),
        lines.alias("lines"),
    )
    n = F.size("words")
    gram = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.expr("cast(array() as array<int>)"))
    keyed = F.transform(places, lambda i: F.struct(gram(F.col("words"), i).alias("h"), i.alias("i")))
    a = a.select(
        "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_stops",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(COMMON_WORD)).cast("long").alias("n_common"), "words", F.sort_array(keyed).alias("s"),
    )
    word = lambda x, by: F.get("words", x["i"] + by)
    equal = lambda x, y: (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    same = lambda x, y: (x["h"] == y["h"]) & equal(x, y)
    twice = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_stops", "n_lines", "n_dup_lines", "n_common", covered.alias("n_repeat_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules: 1 for good, -1 for bad, 0 to abstain."""
    mean = _share("word_chars", "n_words")
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "word_length": _vote(mean.between(3.5, 8.0), (mean < 2.5) | (mean > 11.0)),
        "symbols": _vote(_share("n_symbols", "word_chars") < 0.01, _share("n_symbols", "word_chars") > 0.04),
        "lines": _vote(_share("n_dup_lines", "n_lines") < 0.1, _share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(_share("n_repeat_words", "n_words") < 0.1, _share("n_repeat_words", "n_words") > 0.3),
        "capitals": _vote(_share("n_upper", "word_chars") < 0.1, _share("n_upper", "word_chars") > 0.3),
        "common": _vote(_share("n_common", "n_words") > 0.08, _share("n_common", "n_words") < 0.02),
        "stops": _vote(_share("n_stops", "n_words").between(0.02, 0.4), _share("n_stops", "n_words") > 0.8),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """EM over counted vote patterns (at most 3^8): the prior log odds of good, and by rule each vote's log likelihood ratio.

    It starts from documents that no rule votes bad. A vote weighs what the two classes make of it, to either side; an
    abstention says nothing. Without patterns the prior is even and the votes have no weight."""
    rules = len(patterns[0][0]) if patterns else len(votes())
    total = sum(n for _, n in patterns)
    good = [0.05 if min(p) < 0 else 0.95 for p, _ in patterns]
    prior, weights = 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(rules)]
    for _ in range(rounds if total else 0):
        mass = sum(g * n for g, (_, n) in zip(good, patterns))
        prior = math.log((mass + 1) / (total - mass + 1))
        for j in range(rules):
            for v in (-1, 1):
                in_good = sum(g * n for g, (p, n) in zip(good, patterns) if p[j] == v)
                in_bad = sum((1 - g) * n for g, (p, n) in zip(good, patterns) if p[j] == v)
                weights[j][v] = math.log((in_good + 1) / (mass + 3)) - math.log((in_bad + 1) / (total - mass + 3))
        odds = [prior + sum(weights[j][v] for j, v in enumerate(p)) for p, _ in patterns]
        good = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in odds]
    return prior, weights


def judge(docs: DataFrame) -> DataFrame:
    """Per document its counts, base_failed, the posterior probability of good quality, and kept."""
    rules = votes()
    seen = written(counts(docs).withColumns({f"v_{k}": v for k, v in rules.items()}), "quality")
    names = [f"v_{k}" for k in rules]
    rows = seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^8 rows
    prior, weights = fit([(tuple(r[c] for c in names), r["n"]) for r in rows])
    odds = F.lit(prior)
    for c, w in zip(names, weights):
        odds = odds + F.when(F.col(c) > 0, F.lit(w[1])).when(F.col(c) < 0, F.lit(w[-1])).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
