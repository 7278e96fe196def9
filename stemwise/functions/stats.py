"""Interval and test statistics over counted rows.

Tails come in two forms: native columns, which walk from the tail's largest term for as
many terms as the square root of n, and exact ones as Arrow UDFs over the few aggregated
rows. The exact binomial tail has sixty digits and as many terms as these need, the exact
McNemar tail is by integers, whose cost grows with the square of n.
"""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from fractions import Fraction
from math import comb, exp, factorial, ldexp, lgamma, log, log1p, pi

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

CHANCE = 0.2
Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without trials."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / d, (mid + half) / d


def z_score(k: Column, n: Column, p: float = CHANCE) -> Column:
    return (k - p * n) / F.sqrt(p * (1 - p) * F.nullif(n, F.lit(0)))


def rho(acc: Column, full: Column, chance: float = CHANCE) -> Column:
    """Share of the gain over chance that partial input keeps; null unless full beats chance."""
    return F.when(full > chance, (acc - chance) / (full - chance))


#: Logarithms of 0! to 15!; beyond, Stirling's series is exact to the last digit.
_FACTORIALS = "array(" + ", ".join(f"{lgamma(i + 1)!r}D" for i in range(16)) + ")"
_HALF_LOG_2PI = 0.5 * log(2 * pi)


def _stirling_error(x: str) -> str:
    """ln x! - ln(sqrt(2 pi x) (x / e)^x) for x >= 1."""
    small = f"element_at({_FACTORIALS}, cast({x} as int) + 1) - ({x} + 0.5D) * ln(cast({x} as double)) + {x} - {_HALF_LOG_2PI!r}D"
    large = f"(1 / 12D - (1 / 360D - (1 / 1260D - 1 / (1680D * {x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x}"
    return f"if({x} < 16, {small}, {large})"


def _log_term(k: str, n: str, p: float) -> str:
    """ln of the binomial probability of k of n, by deviances, so nothing large cancels."""
    r, q = f"({n} - {k})", 1 - p
    deviance = lambda x, m: f"({x} * ln({x} / ({m})) + ({m}) - {x})"
    inner = f"{_stirling_error(n)} - ({_stirling_error(k)}) - ({_stirling_error(r)}) - {deviance(k, f'{n} * {p}D')} - {deviance(r, f'{n} * {q!r}D')} + 0.5D * ln({n} / (2 * {pi!r}D * {k} * {r}))"
    return f"case when {k} <= 0 then {n} * ln({q!r}D) when {k} >= {n} then {n} * ln({p}D) else {inner} end"


def _binom_sum(frm: str, to: str, n: str, p: float) -> str:
    """Sum of binomial terms frm..to (frm the largest, going away from the mean). Terms
    beyond 9 sqrt(n) + 60 of them, over 18 deviations away, add nothing. They are held
    times 2**200, so that each is rounded once where it is below the normal doubles."""
    odds, far = p / (1 - p), f"(cast(9 * sqrt({n}) as bigint) + 60)"
    first = f"exp({_log_term(frm, n, p)} + {200 * log(2)!r}D)"
    step = lambda to, ratio: f"aggregate(sequence({frm}, {to}), named_struct('s', 0D, 't', {first}), (a, i) -> named_struct('s', a.s + a.t * {2.0**-200!r}D, 't', a.t * {ratio}), a -> a.s)"
    up = step(f"least({to}, {frm} + {far})", f"({n} - i) / (i + 1) * {odds!r}D")
    down = step(f"greatest({to}, {frm} - {far})", f"i / ({n} - i + 1) / {odds!r}D")
    return f"if({to} >= {frm}, {up}, {down})"


def binom_sf(k: str, n: str, p: float = CHANCE) -> Column:
    """P(X >= k) of Binomial(n, p), from column names; native."""
    k, n = f"cast({k} as bigint)", f"cast({n} as bigint)"
    upper, lower = _binom_sum(k, n, n, p), _binom_sum(f"({k} - 1)", "0L", n, p)
    return F.expr(f"case when {k} <= 0 then 1D when {k} > {n} then 0D when {k} > {n} * {p}D then {upper} else 1D - {lower} end")


def binom_cdf(k: str, n: str, p: float = CHANCE) -> Column:
    """P(X <= k)."""
    k, n = f"cast({k} as bigint)", f"cast({n} as bigint)"
    upper, lower = _binom_sum(f"({k} + 1)", n, n, p), _binom_sum(k, "0L", n, p)
    return F.expr(f"case when {k} < 0 then 0D when {k} >= {n} then 1D when {k} < {n} * {p}D then {lower} else 1D - {upper} end")


def mcnemar(b: str, c: str) -> Column:
    """Exact two-sided McNemar test of discordant counts."""
    n, low = f"cast({b} + {c} as bigint)", f"cast(least({b}, {c}) as bigint)"
    tail = _binom_sum(low, "0L", n, 0.5)
    return F.expr(f"case when {n} = 0 then 1D else least(1D, 2 * if({low} * 2 >= {n}, 1D, {tail})) end")


_DIGITS = Context(prec=60, Emin=-(10**15), Emax=10**15)
#: Of Stirling's series, whose next term is below 10**-60 from 1000 on.
_BERNOULLI = [Fraction(*x) for x in ((1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798), (-174611, 330))]
_TWO_PI = Decimal("6.28318530717958647692528676655900576839433879875021164194988918461563281")


def _log_factorial(x: int) -> Decimal:
    if x < 1000:
        return Decimal(factorial(x)).ln()
    series = sum(Decimal(b.numerator) / (Decimal(b.denominator * 2 * i * (2 * i - 1)) * Decimal(x) ** (2 * i - 1)) for i, b in enumerate(_BERNOULLI, 1))
    return (_TWO_PI * x).ln() / 2 + x * (Decimal(x).ln() - 1) + series


def binom_sf_exact_value(k: int, n: int, p: Fraction = Fraction(1, 5)) -> float:
    """The upper tail, right to the last bit: sixty digits less the size of ln n!, terms
    from the tail's largest until they add nothing."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    with localcontext(_DIGITS):
        a, b = Decimal(p.numerator), Decimal(p.denominator - p.numerator)
        if b == 0:
            return 1.0
        if a == 0:
            return 0.0
        upper = k * p.denominator > n * p.numerator
        i = k if upper else k - 1
        logs = _log_factorial(n) - _log_factorial(i) - _log_factorial(n - i)
        term = (logs + i * a.ln() + (n - i) * b.ln() - n * Decimal(p.denominator).ln()).exp()
        total = Decimal(0)
        while term > total * Decimal("1e-45"):
            total += term
            term = term * ((n - i) * a) / ((i + 1) * b) if upper else term * (i * b) / ((n - i + 1) * a)
            i += 1 if upper else -1
        return float(total if upper else 1 - total)


@F.pandas_udf(DoubleType())
def binom_sf_exact(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binom_sf_exact_value(int(x), int(y)) for x, y in zip(k, n, strict=True)])


def mcnemar_exact_value(b: int, c: int) -> float:
    n = b + c
    return 1.0 if n == 0 else min(1.0, float(Fraction(2 * sum(comb(n, i) for i in range(min(b, c) + 1)), 2**n)))


def _deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x, without loss where the two are near."""
    if x == 0:
        return m
    d = x - m
    if abs(d) > 0.1 * (x + m):
        return x * log(x / m) - d
    v = d / (x + m)
    total, power, i = d * v, 2 * x * v, 3
    while True:
        power *= v * v
        more = total + power / i
        if more == total:
            return total
        total, i = more, i + 2


def _stirling(x: int) -> float:
    """ln x! - ln(sqrt(2 pi x) (x / e)^x) for x >= 1."""
    if x < 16:
        return lgamma(x + 1) - (x + 0.5) * log(x) + x - _HALF_LOG_2PI
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """ln of the probability of x of n, by deviances."""
    if x == 0:
        return n * log(q) if p > 0.1 else n * log1p(-p)
    if x == n:
        return n * log(p) if q > 0.1 else n * log1p(-q)
    inner = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return inner + 0.5 * log(n / (2 * pi * x * (n - x)))


def fisher_value(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact: all tables no likelier than the observed one.

    Likelihood falls on either side of its mode, so these are two tails: one starts at the
    observed table, the start of the other is found by bisection. Each is walked until its
    terms add nothing, some multiple of the square root of n."""
    n = a + b + c + d
    row, col = sorted((a + b, a + c))
    low, high = max(0, row + col - n), row
    mode = min(max((row + 1) * (col + 1) // (n + 2), low), high)
    if low == high or a == mode:
        return 1.0
    p, q = row / n, (n - row) / n
    weigh = lambda x: _log_binomial(x, col, p, q) + _log_binomial(row - x, n - col, p, q) - _log_binomial(row, n, p, q)
    limit = weigh(a) + log1p(1e-7)
    if weigh(mode) <= limit:
        return 1.0
    away = 1 if a > mode else -1
    near, far = mode, low - 1 if away > 0 else high + 1  # likelier than the limit, and not
    while abs(far - near) > 1:
        x = (near + far) // 2
        near, far = (near, x) if weigh(x) <= limit else (x, far)

    def tail(x: int, step: int) -> float:
        total, term = 0.0, exp(weigh(x) + 200 * log(2)) if low <= x <= high else 0.0
        while term > 0 and ldexp(term, -200) > total * 1e-20:
            total += ldexp(term, -200)
            if step > 0:
                term *= (row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1))
            else:
                term *= x * (n - row - col + x) / ((row - x + 1) * (col - x + 1))
            x += step
        return total

    return min(1.0, tail(a, away) + tail(far, -away))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_value(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


@F.pandas_udf(DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_exact_value(int(x), int(y)) for x, y in zip(b, c, strict=True)])
