"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Everything is a column expression. A pattern's matches and the text between them come from one `regexp_extract_all` and
one `split`; a fold over both gives each match its code-point offsets, so no text is walked twice per match.

The four base kinds stay whatever their score. Of the others a match stays from LEAST_SCORE on: an account number by its
checksum alone, a key or a social security number, whose checks prove little, only near a word of its context.

Defined cases: a null or empty text has no spans; kinds may overlap each other but not themselves; a very long text is
walked once per kind that its characters allow; rows are never dropped or merged, so repeated rows give repeated results
and a null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns. Possessive repeats and the look-behinds only spare work on long runs of one kind of
#: character: a run is tried once, at its start (or where the match before ended, `\G`), as later starts meet the same end.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind more likely when they stand just before it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential",
    "ssn": "ssn|social.security",
}
#: A pattern's own score, what its check adds, what a context word adds; the least score that is kept.
PATTERN_SCORE, CONTEXT_SCORE, LEAST_SCORE = 0.5, 0.2, 0.75
CHECK_SCORE = {"email": 0.0, "ip": 0.3, "card": 0.3, "phone": 0.0, "iban": 0.3, "secret": 0.1, "ssn": 0.1}
CONTEXT_CHARS = 40

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn checksum; leading zeros don't change it."""
    padded = F.lpad(digits, 20, "0")
    weighed = [F.substring(padded, i, 1).cast("int") * (2 if i % 2 else 1) for i in range(1, 21)]
    return sum((F.when(w > 9, w - 9).otherwise(w) for w in weighed), F.lit(0)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number of digits and capitals leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    """The check that a proposed match has to pass."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(found, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", ""))
    if kind == "secret":  # digits among letters, and not one letter or digit again and again
        return found.rlike("[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]") & (F.length(F.regexp_replace(found, r"(.)(?=.*\1)", "")) >= 8)
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, gap: Column) -> Column:
    """The score of a confirmed match from the text between it and the one before: whether a context word is near."""
    base = PATTERN_SCORE + CHECK_SCORE[kind]
    near = F.lower(F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS)).rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})")
    return F.when(near, F.lit(base + CONTEXT_SCORE)).otherwise(F.lit(base))


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind in order, with scores; offsets count code points, the end is exclusive."""
    pattern = PATTERNS[kind]
    guard = F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else text.rlike(pattern if kind in ("iban", "secret", "ssn") else "[0-9]")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walk = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["m"], F.lit("")))
        score = _score(kind, x["gap"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        keep = x["m"].isNotNull() & confirmed(kind, x["m"])
        if kind not in BASE:
            keep &= score >= LEAST_SCORE
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    folded = F.aggregate(walk, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(guard, folded).otherwise(none)


def find(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: its id and, by kind, the spans found in its whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("doc_id"), whole.alias("text")).select("doc_id", *(spans_of(F.col("text"), k).alias(k) for k in PATTERNS))


def _joined(*kinds: str) -> Column:
    every = F.concat(*kinds) if len(kinds) > 1 else F.col(kinds[0])
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, all spans as text, and counts of the others and in all, with the
    scores of the spans in the same order."""
    found = find(docs)
    counts = {k: F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS}
    scores = F.array_join(F.transform(F.concat(*PATTERNS), lambda s: F.format_number(s["score"], 1)), ",")
    every = sum((F.size(k) for k in PATTERNS), F.lit(0)).cast("long").alias("n_spans")
    more = [counts[k] for k in PATTERNS if k not in BASE]
    return found.select("doc_id", *(counts[k] for k in BASE), F.sha2(_joined(*BASE), 256).alias("base_sha256"), _joined(*PATTERNS).alias("spans"), scores.alias("scores"), *more, every)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span that digest() gives replaced by its kind in angle brackets.

    The text is cut at the pattern's matches and joined again, kind by kind, so later kinds see the earlier replacements;
    a kind's context word has to stand in the same gap, as when spans are found."""
    out = docs
    for kind in PATTERNS:
        out = out.withColumn(text, _replaced(F.col(text), kind))
    return out


def _replaced(text: Column, kind: str) -> Column:
    pattern = PATTERNS[kind]

    def part(gap: Column, m: Column) -> Column:
        keep = confirmed(kind, m)
        if kind not in BASE:
            keep &= _score(kind, gap) >= LEAST_SCORE
        return F.concat(gap, F.when(m.isNull(), F.lit("")).when(keep, F.lit(f"<{kind}>")).otherwise(m))

    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part), "")
