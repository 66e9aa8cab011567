"""Column functions: hashed random numbers, business days, tolerant casts, text tests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary of scheduled and of binary events.
SCHEDULED = (
    "fomc|meeting|statement|decision|release|cpi|nfp|payroll|hike|cut|dot|minutes|speech|"
    "testimony|taper|pace|qqe|purchase|conference|press|jackson|beige|gdp|pce|inflation print"
)
BINARY = (
    "binary|referendum|election|vote|peg|floor|band|default|downgrade|emergency|bank run|"
    "failure|collapse|war|invasion|virus|outbreak|pandemic|guidance|withdraw|shutdown|ceiling|"
    "brexit|devalu|intervention"
)
# Currencies quoted as dollars per unit, and as units per dollar.
DOLLARS_PER = ("EUR", "GBP", "AUD", "NZD")
PER_DOLLAR = (
    "JPY", "CHF", "CAD", "SEK", "NOK", "DKK", "CNY", "CNH", "BRL", "INR", "MXN",
    "ZAR", "TRY", "KRW", "TWD", "SGD", "PLN", "HUF", "CZK", "RUB", "THB", "IDR",
)


def uniform(seed: int, stream: str | Column, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on seed, stream and the key columns only, not on partitions."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream) if isinstance(stream, str) else stream, *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, stream: str | Column, *keys: str | Column) -> Column:
    """A standard normal number by Box and Muller."""
    r, a = (f"{stream}.{x}" if isinstance(stream, str) else F.concat(stream, F.lit(f".{x}")) for x in "ra")
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, r, *keys)))
    return radius * F.cos(F.lit(2 * np.pi) * uniform(seed, a, *keys))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


#: Tries of the rejection for a gamma number; each fails with a chance below 0.05, so all do in one of 10^15 draws.
GAMMA_TRIES = 12


def chi_square(seed: int, df: Column, *keys: str) -> Column:
    """A chi-square number for any positive df: twice a gamma number, by rejection on hashed counters (Marsaglia and Tsang).

    A try is computed only where those before it failed. Below 2 degrees of freedom a
    number of two more is scaled down by a power of a uniform one.
    """
    shape = df / 2
    up = F.when(shape < 1, shape + 1).otherwise(shape)
    d = up - F.lit(1.0 / 3.0)

    def attempt(k: Column) -> Column:
        name = F.concat(F.lit("gamma"), k.cast("string"))

        def judged(x: Column, v: Column) -> Column:
            u = F.lit(1.0) - uniform(seed, F.concat(name, F.lit(".u")), *keys)
            good = (v > 0) & (F.log(u) < x * x * 0.5 + d - d * v + d * F.log(F.when(v > 0, v)))
            return F.when(good, d * v)

        return bound(normal(seed, name, *keys), lambda x: bound(F.pow(F.lit(1.0) + x / F.sqrt(d * 9), F.lit(3)), lambda v: judged(x, v)))

    none = F.lit(None).cast("double")
    found = F.aggregate(F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)), none, lambda done, k: F.coalesce(done, attempt(k)))
    low = F.when(shape < 1, F.pow(F.lit(1.0) - uniform(seed, "gamma.low", *keys), F.lit(1.0) / shape)).otherwise(1.0)
    return F.coalesce(found, d) * low * 2


def add_business_days(day: Column, n: Column) -> Column:
    """The n-th weekday after a date, n >= 1; a weekend counts as the Friday before."""
    weekday = F.least(F.weekday(day), F.lit(4))
    back = F.weekday(day) - weekday
    weeks = F.floor((weekday + n) / 5).cast("int")
    return F.date_add(F.date_sub(day, back), weeks * 7 + F.pmod(weekday + n, F.lit(5)) - weekday)


def number(x: Column, default: float | None = 0.0) -> Column:
    """A finite double of a string, else the default."""
    v = x.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v), F.lit(default).cast("double"))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def json_object(text: Column) -> Column:
    """The outermost braces of an answer with fences or prose around it; null without an object."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def real_event(exists: Column, kind: Column, words: Column, strict: bool = True) -> Column:
    """Whether an event in the window is binary rather than scheduled."""
    k = F.coalesce(F.lower(F.trim(kind)), F.lit(""))
    text = F.coalesce(words, F.lit(""))
    by_words = text.rlike(f"(?i)({BINARY})") & ~text.rlike(f"(?i)({SCHEDULED})")
    judged = F.when(k.startswith("binary"), True).when(k.startswith("scheduled"), False).otherwise(by_words)
    return truthy(exists) & (judged if strict else F.lit(True))


def direction_hint(asset: Column, panel: Column, space: Column) -> Column:
    """What +1 means for an asset's value, in words."""
    token = F.regexp_replace(F.upper(asset), "[^A-Z]", "")
    quoted = F.lower(panel).rlike("fx|transfer") | F.substring(token, 1, 3).isin(*DOLLARS_PER, *PER_DOLLAR)
    base, quote = (F.regexp_extract(token, "|".join(c), 0) for c in (DOLLARS_PER, PER_DOLLAR))
    return (
        F.when(space == "cumlog", F.concat(F.lit("+1: positive return of "), asset))
        .when(quoted & (base != ""), F.concat(F.lit("dollars per "), base, F.lit(", +1: "), base, F.lit(" gains")))
        .when(quoted & (quote != ""), F.concat(quote, F.lit(" per dollar, +1: "), quote, F.lit(" loses")))
        .when(space == "diff", F.concat(F.lit("+1: higher rate of "), asset))
        .otherwise(F.concat(F.lit("+1: higher value of "), asset))
    )
