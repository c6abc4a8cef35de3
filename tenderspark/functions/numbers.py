"""Scores, vectors, money and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars for a million tokens in and out.
PRICES = {
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-embedding-001": (0.15, 0.0),
    "gemini-2.0-flash": (0.10, 0.40),
    "text-embedding-004": (0.0, 0.0),
    "Qwen/Qwen2.5-72B-Instruct": (0.0, 0.0),
    "Qwen/Qwen2.5-7B-Instruct": (0.0, 0.0),
    "Qwen/Qwen3-Embedding-8B": (0.0, 0.0),
}


def half_up(c: Column) -> Column:
    """As browsers round."""
    return F.floor(c + 0.5)


def compliance_score(addressed: Column, partial: Column, every: Column, na: Column) -> Column:
    """100 (addressed + partial / 2) / (all - na), half to even; 0 where nothing counts."""
    scorable = every - na
    return F.when(scorable > 0, F.bround((addressed + partial * 0.5) * 100.0 / scorable, 0)).otherwise(0.0).cast("int")


def est_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    cost = tokens_in / F.lit(1e6) * price_in + tokens_out / F.lit(1e6) * price_out
    return F.coalesce(F.bround(cost, 4), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit_vector(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n)))[0]


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def days_until(date: Column, now: Column) -> Column:
    return F.ceil((F.unix_timestamp(date) - F.unix_timestamp(now)) / 86_400)


def dollars(c: Column) -> Column:
    """$1,234.5: up to two decimals, none that are zero."""
    shown = F.regexp_replace(F.regexp_replace(F.format_number(F.abs(c), 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.when(c < 0, "-$").otherwise("$"), shown)


def format_currency(c: Column, compact: bool = False) -> Column:
    if not compact:
        return dollars(c)
    million = F.concat(F.lit("$"), F.format_string("%.1f", c / 1e6), F.lit("M"))
    thousand = F.concat(F.lit("$"), F.format_string("%.0f", c / 1e3), F.lit("K"))
    return F.when(c >= 1e6, million).when(c >= 1e3, thousand).otherwise(dollars(c))


def money_rounded(c: Column) -> Column:
    """$1,235"""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(c, F.lit(0.0)), 0))
