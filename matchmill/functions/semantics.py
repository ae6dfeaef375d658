"""Scalar rules that all operators share: coercion, rounding, names, keys, dates, minutes, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"


def falsy_or(x: Column, default: Column | float | str) -> Column:
    """`default` where a number is null, zero or NaN, or a string is null or empty once cast."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(x.isNull() | x.cast("string").isin("", "0", "0.0", "-0.0", "NaN", "false"), d).otherwise(x)


def to_number(x: Column, strict: bool = False) -> Column:
    """A decimal comma counts as a point; other text gives null. Blank gives 0, or null if strict."""
    clean = F.trim(F.coalesce(x, F.lit("")))
    blank = F.lit(None).cast("double") if strict else F.lit(0.0)
    return F.when(clean == "", blank).otherwise(_as_double(F.regexp_replace(clean, "^([^,]*),", "$1.")))


def _as_double(x: Column) -> Column:
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x).cast("double")


def half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, on both sides of zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def to_fixed(x: Column, digits: int = 0) -> Column:
    """x to so many digits by its exact binary value; only exact halves go away from zero.

    The product with the power of ten is taken without error, as its rounded value and what rounding left out, by splitting
    both factors into halves of their bits. So 1.45, which is a little less than that, gives 1.4."""
    return F.get(F.transform(F.array(x.cast("double")), lambda v: _fixed(v, float(10**digits))), F.lit(0))  # x is worked out once


def _fixed(x: Column, scale: float) -> Column:
    high, low = _halves(scale)
    size = F.abs(x)
    big = size * SPLITTER
    top = big - (big - size)
    rest = size - top
    product = size * scale
    whole = F.floor(product)
    error = ((top * high - product) + top * low + rest * high) + rest * low
    up = ((product - whole) - 0.5) + error >= 0
    rounded = F.signum(x) * ((whole + F.when(up, 1).otherwise(0)) / scale) + F.lit(0.0)
    return F.when(F.isnan(x) | (product >= WHOLE), x).otherwise(rounded)


#: A factor that splits a double's 53 bits into two halves; from WHOLE on every double is a whole number.
SPLITTER, WHOLE = 134217729.0, float(2**53)


def _halves(x: float) -> tuple[float, float]:
    top = x * SPLITTER - (x * SPLITTER - x)
    return top, x - top


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: Accented Latin letters that decompose, and their base letters. Letters that don't decompose become spaces.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def normalize_name(x: Column) -> Column:
    """Lower case, accents gone, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


#: Club suffixes and prefixes of which the first occurrence may be missing in another source's name.
CLUB_AFFIXES = ("fc ", " cf", " afc", " sc", " ac")


def possible_names(x: Column) -> Column:
    """The normalised name and its variants with one affix removed, without repeats, best first."""
    name = normalize_name(x)
    cut = [F.trim(F.concat(F.substring_index(name, a, 1), F.when(F.contains(name, F.lit(a)), F.substr(name, F.instr(name, a) + F.lit(len(a)))).otherwise(F.lit("")))) for a in CLUB_AFFIXES]
    return F.array_distinct(F.filter(F.array(name, *cut), lambda n: n != ""))


def team_key(id: Column, name: Column) -> Column:
    return F.when(F.coalesce(id.cast("string"), F.lit("")) != "", F.concat(F.lit("id:"), id.cast("string"))).otherwise(F.concat(F.lit("name:"), normalize_name(name)))


def pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.array(normalize_name(a), normalize_name(b)), lambda n: n != "")), "__")


def local_day(ts: Column) -> Column:
    """Day of an instant in the league's zone; timestamps without zone are UTC."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE))


def parse_day(x: Column, pivot: int | None = 70) -> Column:
    """d/m/yy, d/m/yyyy or an ISO day. Two-digit years from `pivot` on are of the last century, or all of this one."""
    d, m, y = (F.regexp_extract(x, r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 4, y.cast("int")).otherwise(y.cast("int") + (F.when(y.cast("int") >= pivot, 1900).otherwise(2000) if pivot is not None else F.lit(2000)))
    slash = F.when(y != "", F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    return F.coalesce(F.try_to_timestamp(slash, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd"))).cast("date")


def minute_value(x: Column) -> Column:
    """45+2 gives 47, HT gives 45; text without a number gives null."""
    base, extra = F.regexp_extract(x, r"(\d+)", 1), F.regexp_extract(x, r"\d+\s*\+\s*(\d+)", 1)
    number = F.when(base != "", base.cast("int")) + F.when(extra != "", extra.cast("int")).otherwise(F.lit(0))
    return F.when(F.upper(F.trim(x)) == "HT", F.lit(45)).otherwise(number)


def parse_score(x: Column) -> list[Column]:
    """Home and away goals of a text as `2-1`: the numbers before and after the first dash; null if either is none, and an
    empty part counts as 0."""
    parts = F.split(x, "-")
    one = lambda i: F.when(F.trim(F.get(parts, F.lit(i))) == "", F.lit(0.0)).otherwise(_as_double(F.trim(F.get(parts, F.lit(i)))))
    home, away = one(0), one(1)
    both = F.contains(x, F.lit("-")) & home.isNotNull() & away.isNotNull()
    return [F.when(both, home), F.when(both, away)]


def described_minute(text: Column) -> tuple[Column, Column]:
    """Minute and extra time in a description as `45+2` or `67th minute`; null and null without a number."""
    number = lambda pattern, i: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i).cast("int"))
    plus = r"(\d+)\s*\+\s*(\d+)"
    current = F.coalesce(number(plus, 1), number(r"(\d+)", 1))
    return current, F.coalesce(number(plus, 2), F.when(current.isNotNull(), F.lit(0)))


def minute_state(current: Column, extra: Column, *descriptions: Column) -> Column:
    """A struct of minute_value and extra_time: as given, else as the first description that has a number says; 0 is none."""
    parsed = [described_minute(d) for d in descriptions]
    of = lambda given, i: F.nullif(F.coalesce(given.cast("int"), F.coalesce(*(F.when(p[0].isNotNull(), p[i]) for p in parsed), F.lit(None).cast("int")), F.lit(0)), F.lit(0))
    return F.struct(of(current, 0).alias("minute_value"), of(extra, 1).alias("extra_time"))


def live_label(minute: Column, minutes_since: Column) -> Column:
    """A running minute; from 90 on `90+`."""
    now = minute + F.floor(minutes_since).cast("int")
    return F.when(now >= 90, F.lit("90+")).otherwise(F.concat(now.cast("string"), F.lit("'")))


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, F.lit("H")).when(home < away, F.lit("A")).when(home == away, F.lit("D"))


def expected_score(elo: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - elo) / 400))


def poisson(rate: Column, k: int) -> Column:
    from math import factorial

    return F.pow(rate, F.lit(float(k))) * F.exp(-rate) / float(factorial(k))


def low_score_factor(h: int, a: int, home: Column, away: Column, rho: float = -0.13) -> Column:
    """The Dixon-Coles correction of the four lowest scores."""
    cells = {(0, 0): 1 - home * away * rho, (0, 1): 1 + home * rho, (1, 0): 1 + away * rho, (1, 1): F.lit(1 - rho)}
    return cells.get((h, a), F.lit(1.0))
