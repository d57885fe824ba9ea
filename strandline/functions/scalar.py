"""Column expressions: calendar, amounts, rounding, statistics, text keys."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- numbers ---------------------------------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round half up towards +infinity; never yields -0.0."""
    scale = float(10**digits)
    return F.floor(_c(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def tdiv(a: Column | str, b: Column | str) -> Column:
    """Division that is NULL on a zero denominator."""
    return F.try_divide(_c(a), _c(b))


def clamp(x: Column | str, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    x = _c(x)
    return F.when(x.isNotNull(), F.least(hi, F.greatest(lo, x)))


def sigmoid(z: Column | str) -> Column:
    z = _c(z)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    p = _c(p)
    return F.ln(F.greatest(F.lit(eps), p) / F.greatest(F.lit(eps), 1 - p))


def pct(log_return: Column | str) -> Column:
    """Log return as a percent change."""
    return (F.exp(_c(log_return)) - 1) * 100


def quarterly_rate(annual: Column | str) -> Column:
    return F.pow(1 + _c(annual), F.lit(0.25)) - 1


# Abramowitz-Stegun 7.1.26 coefficients of the complementary error function.
ERFC_P = 0.3275911
ERFC_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column | str) -> Column:
    x = _c(x)
    t = 1 / (1 + F.lit(ERFC_P) * F.abs(x))
    poly = F.lit(0.0)
    for coefficient in reversed(ERFC_COEFFICIENTS):
        poly = (poly + F.lit(coefficient)) * t
    y = poly * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(2 - y)


def p_value_above(k: Column, n: Column, p0: Column | float) -> Column:
    """One-sided p-value that k hits of n beat rate p0 (normal approximation)."""
    p0 = p0 if isinstance(p0, Column) else F.lit(float(p0))
    z = tdiv(k - n * p0, F.sqrt(n * p0 * (1 - p0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(0.5) * erfc(z / F.lit(2.0**0.5)))


def floor_quantile(c: Column | str, p: float) -> Column:
    """Order statistic at floor(p*(n-1)); aggregate for bounded groups only (it collects the group's values)."""
    values = F.sort_array(F.collect_list(_c(c)))
    return F.element_at(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int") + 1)


def parse_amount(c: Column | str) -> Column:
    """Comma-formatted number, NULL when it is not one."""
    text = F.regexp_replace(F.trim(_c(c).cast("string")), ",", "")
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))


def signed_amount(c: Column | str) -> Column:
    """Signed share count such as '+1,200' or '-300'."""
    text = F.regexp_replace(_c(c).cast("string"), r"[,+\s]", "")
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))


# ---- calendar --------------------------------------------------------------------------------------------------


def quarter_index(d: Column | str) -> Column:
    """Quarter of a date as year*4 + quarter - 1."""
    d = _c(d)
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def parse_quarter(label: Column | str) -> Column:
    label = _c(label)
    return (F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int") - 1).cast("int")


def format_quarter(q: Column | str) -> Column:
    q = _c(q)
    return F.concat(F.floor(q / 4).cast("string"), F.lit("Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))


def quarter_start(q: Column | str) -> Column:
    q = _c(q)
    return F.make_date(F.floor(q / 4).cast("int"), (F.pmod(q, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(q: Column | str) -> Column:
    return F.last_day(F.add_months(quarter_start(q), 2))


def instant_days(a: Column | str, b: Column | str) -> Column:
    """Fractional days from instant a to instant b."""
    return (F.unix_millis(_c(b)) - F.unix_millis(_c(a))) / F.lit(86400000.0)


def kst_date(ts: Column | str) -> Column:
    """Calendar date in Korea (UTC+9, no daylight saving) of an instant."""
    return F.to_date(F.from_utc_timestamp(_c(ts), "Asia/Seoul"))


def valid_date(text: Column | str) -> Column:
    text = _c(text)
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def valid_instant(text: Column | str) -> Column:
    """ISO instant with an explicit offset and a real calendar date."""
    text = _c(text)
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    real = valid_date(F.substring(text, 1, 10)) & text.try_cast("timestamp").isNotNull()
    return F.coalesce(shape & real, F.lit(False))


def as_of_cutoff(as_of: Column | str) -> Column:
    """A date-only as-of means the end of that day in Korea; a full instant means itself."""
    as_of = _c(as_of)
    day_end = F.to_utc_timestamp(
        F.concat(as_of, F.lit(" 23:59:59.999")).try_cast("timestamp"), "Asia/Seoul")
    return F.when(valid_date(as_of), day_end).otherwise(as_of.try_cast("timestamp"))


# The middle of a reporting period lies about 45 days before its end; a month has 30.44 days.
MID_QUARTER_DAYS = 45
MONTH_DAYS = 30.44
EXACT_EDGE_DAYS = 7


def calendar_label(end: Column | str, months: Column | str) -> tuple[Column, Column]:
    """(calendar label, exact?) of a fiscal period given its end date and length in months."""
    end, months = _c(end), _c(months)
    end_ms = F.unix_date(end).cast("double") * 86400000.0
    last_q = quarter_index(F.to_date(F.timestamp_millis((end_ms - MID_QUARTER_DAYS * 86400000.0).cast("long"))))
    first_ms = end_ms - (months * F.lit(MONTH_DAYS) - MID_QUARTER_DAYS) * 86400000.0
    first_q = quarter_index(F.to_date(F.timestamp_millis(F.floor(first_ms))))
    exact = F.abs(F.datediff(end, quarter_end(last_q))) <= EXACT_EDGE_DAYS
    label = F.when(months == 3, format_quarter(last_q)).otherwise(
        F.concat(format_quarter(first_q), F.lit("~"), format_quarter(last_q)))
    return label, exact


# ---- text ------------------------------------------------------------------------------------------------------


def title_key(c: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}]+", "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC form (Spark has no built-in for it)."""
    return s.str.normalize("NFKC")


# Control characters an entity could smuggle in are dropped; a no-break space counts as a space.
_CLEAN = {**{c: None for c in range(32) if c not in (9, 10, 13)}, 0xA0: " "}


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda text: html.unescape(text).translate(_CLEAN), na_action="ignore")


def sector_key(c: Column | str) -> Column:
    return F.lower(nfkc(F.trim(_c(c))))


# Legal forms dropped from a company name before names are compared.
LEGAL_FORMS = r"\(주\)|㈜|주식회사|\s+"


def company_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(nfkc(_c(c)), LEGAL_FORMS, ""))


def strip_tags(c: Column | str) -> Column:
    """Markup to single-spaced text."""
    no_tags = F.regexp_replace(_c(c), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(no_tags), r"\s+", " "))


# Listing codes by country.
TICKER_PATTERN = r"^[0-9][0-9A-Z]{5}$"
COMPETITOR_PATTERN = r"^\s*(KR:[0-9][0-9A-Z]{5}|US:[A-Z][A-Z0-9.-]{0,9}|JP:[0-9][0-9A-Z]{3})\s*$"


def parse_competitor_id(c: Column | str) -> Column:
    """Competitor id as a (country, symbol) struct, NULL when malformed."""
    text = F.regexp_replace(F.upper(_c(c)), r"\s", "")
    return F.when(text.rlike(COMPETITOR_PATTERN), F.struct(
        F.split_part(text, F.lit(":"), F.lit(1)).alias("country"),
        F.split_part(text, F.lit(":"), F.lit(2)).alias("symbol")))


def content_hash(columns: list[str]) -> Column:
    """Order-independent sha256 of the named columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)

