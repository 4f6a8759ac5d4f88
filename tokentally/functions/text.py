"""Text and display numbers. All rounding is done on whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display units.
UNITS = [(1_000_000_000_000, "T"), (1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K")]


def whole_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _one_decimal(tenths: Column) -> Column:
    whole = F.format_number(whole_div(tenths, 10), 0)
    digit = F.pmod(tenths, F.lit(10))
    return F.when(digit == 0, whole).otherwise(F.concat(whole, F.lit("."), digit.cast("string")))


def compact_number(value: Column) -> Column:
    """1234567 -> 1.2M, for whole numbers of zero or more."""
    out = F.when(value < 1_000, F.format_number(value, 0))
    for size, suffix in reversed(UNITS):
        upper = value < size * 1_000 if suffix != "T" else F.lit(True)
        out = out.when(upper, F.concat(_one_decimal(whole_div(value * 10 + size // 2, size)), F.lit(suffix)))
    return out


def count_text(value: Column, noun: str) -> Column:
    plural = noun if noun.endswith("s") else noun + "s"
    return F.concat(compact_number(value), F.lit(" "), F.when(value == 1, noun).otherwise(plural))


def tokens_text(value: Column) -> Column:
    return count_text(value, "token")


def percent_text(part: Column, whole: Column) -> Column:
    """part / whole as a percentage with at most one decimal; 0% when whole is 0."""
    tenths = whole_div(part * 1_000 + whole_div(whole, 2), F.nullif(whole, F.lit(0)))
    return F.concat(_one_decimal(F.coalesce(tenths, F.lit(0).cast("bigint"))), F.lit("%"))


def money_text(micro: Column) -> Column:
    cents = whole_div(micro + 5_000, 10_000)
    dollars = F.format_number(whole_div(cents, 100), 0)
    text = F.concat(F.lit("$"), dollars, F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"), F.lit(" USD"))
    return F.when(micro.isNull(), "Not priced").when((micro > 0) & (micro < 10_000), "<$0.01 USD").otherwise(text)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def timeline_text(text: Column) -> Column:
    return F.substring(collapse_spaces(text), 1, 1000)


def truncate_text(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def clean_title(text: Column) -> Column:
    """A title without Markdown links and repeated white space."""
    return collapse_spaces(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def token_amount(text: Column) -> Column:
    """'1.9M' -> 1900000; NULL without a number."""
    pattern = r"(?i)([\d.]+)\s*([kmb])?"
    plain = F.regexp_replace(text, ",", "")
    number = F.regexp_extract(plain, pattern, 1).try_cast("decimal(20,6)")
    unit = F.lower(F.regexp_extract(plain, pattern, 2))
    scale = F.when(unit == "b", 1_000_000_000).when(unit == "m", 1_000_000).when(unit == "k", 1_000).otherwise(1)
    return F.round(number * scale.cast("decimal(10,0)")).cast("bigint")


def duration_amount(text: Column) -> Column:
    """'2m3s', '4.5s', '12ms', '1h' -> milliseconds; 0 without a number."""
    plain = F.lower(F.trim(text))
    clock = r"([\d.]+)m(?:(\d+(?:\.\d+)?)s)?"
    simple = r"([\d.]+)\s*(ms|s|m|h)?"
    minutes = F.regexp_extract(plain, clock, 1).try_cast("double")
    seconds = F.coalesce(F.regexp_extract(plain, clock, 2).try_cast("double"), F.lit(0.0))
    number = F.regexp_extract(plain, simple, 1).try_cast("double")
    unit = F.regexp_extract(plain, simple, 2)
    scale = F.when(unit == "h", 3_600_000.0).when(unit == "m", 60_000.0).when(unit == "s", 1_000.0).otherwise(1.0)
    return F.coalesce(F.when(plain.rlike(clock), minutes * 60_000 + seconds * 1_000).otherwise(number * scale), F.lit(0.0))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
