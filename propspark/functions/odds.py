"""Odds, fair prices, expected value and settlement as column expressions.

American odds of 0 and null give null unless a default is asked for.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Decimal price of -110, the usual one where none is known.
DEFAULT_DECIMAL = 1.909


def _c(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def decimal_odds(american: Column | str, default: float | None = None) -> Column:
    a = _c(american)
    price = F.when(a > 0, a / 100 + 1).when(a < 0, 100 / F.abs(a) + 1)
    return price if default is None else F.coalesce(price, F.lit(default))


def implied_probability(american: Column | str) -> Column:
    a = _c(american)
    return F.when(a > 0, 100 / (a + 100)).when(a < 0, F.abs(a) / (F.abs(a) + 100))


def devig(over: Column | str, under: Column | str) -> Column:
    """Fair probability of the over: its share of both sides' implied probabilities."""
    p, q = implied_probability(over), implied_probability(under)
    return p / (p + q)


def vig(over: Column | str, under: Column | str) -> Column:
    return implied_probability(over) + implied_probability(under) - 1


def clamp_odds(american: Column | str, limit: int = 99_999) -> Column:
    """Odds held within the limit on either side; unknown ones stay null."""
    a = F.col(american) if isinstance(american, str) else american
    return F.when(a.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), a)))


def exchange_fair(last: Column, over_available: Column, under_available: Column, how: str = "mid") -> Column:
    """Fair probability of the over from an exchange: last trade, share of available prices, or the middle of bid and ask."""
    last, over, under = _c(last), _c(over_available), _c(under_available)
    forms = {"last": last, "available": over / (over + under), "mid": (over + (1 - under)) / 2}
    return forms[how]


def expected_value(p: Column | str, american: Column | str) -> Column:
    """Profit to be expected per unit staked at probability p."""
    return _c(p) * decimal_odds(american) - 1


def best_side(p_over: Column | str, over: Column | str, under: Column | str) -> dict[str, Column]:
    """Both expected values and the better side's name, value, payout and probability. Ties go to the over."""
    p = _c(p_over)
    ev_over, ev_under = expected_value(p, over), expected_value(1 - p, under)
    is_over = ev_over >= ev_under
    pick = lambda a, b: F.when(is_over, a).when(~is_over, b)
    return {
        "ev_over": ev_over,
        "ev_under": ev_under,
        "side": pick(F.lit("over"), F.lit("under")),
        "ev": pick(ev_over, ev_under),
        "payout": pick(decimal_odds(over), decimal_odds(under)),
        "p_bet": pick(p, 1 - p),
    }


def outcome(side: Column | str, actual: Column | str, line: Column | str) -> Column:
    """win, loss or push; null while the result is unknown."""
    side = F.col(side) if isinstance(side, str) else side
    a, x = _c(actual), _c(line)
    return F.when(a == x, "push").when((side == "over") == (a > x), "win").when((side == "over") != (a > x), "loss")


def profit(result: Column | str, payout: Column | str, stake: float = 1.0) -> Column:
    result = F.col(result) if isinstance(result, str) else result
    return F.when(result == "win", (_c(payout) - 1) * stake).when(result == "loss", F.lit(-stake)).when(result == "push", F.lit(0.0))


def two_step_gate(p_model: Column | str, fair_median: Column | str, best_american: Column | str, min_edge: float) -> Column:
    """Whether the model beats the median fair price by min_edge and the best price's breakeven."""
    p = _c(p_model)
    return (p - _c(fair_median) >= min_edge) & (p > implied_probability(best_american))


def side_shade(p: Column | str, year: Column | str, shades: dict[int, float]) -> Column:
    """p less the shade of its year, 0 for years without one."""
    table = F.create_map(*[F.lit(x) for kv in shades.items() for x in kv])
    return _c(p) - F.coalesce(F.try_element_at(table, F.col(year) if isinstance(year, str) else year), F.lit(0.0))


def kelly_fraction(p: Column | str, payout: Column | str, share: float = 1.0, cap: float | None = None) -> Column:
    """Kelly stake times `share`, at least 0 and at most `cap`; null where the probability or the payout is, or the payout wins nothing."""
    b = _c(payout) - 1
    edge = F.when(b > 0, (_c(p) * b - (1 - _c(p))) / b)
    stake = F.greatest(F.lit(0.0), edge) * share
    return F.when(edge.isNotNull(), stake if cap is None else F.least(stake, F.lit(cap)))


def elo_expectation(own: Column | str, other: Column | str) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (_c(other) - _c(own)) / 400))


def margin_multiplier(margin: Column | str) -> Column:
    """log(1 + margin), and 1 for a draw."""
    return F.when(_c(margin) == 0, 1.0).otherwise(F.log1p(F.abs(_c(margin))))


def poisson_tail(line: Column | str, mean: Column | str) -> Column:
    """P(X > line) of a Poisson count, by recursion over the counts up to the line; null where the line or the mean is."""
    m, top = _c(mean), F.floor(_c(line)).cast("int")
    start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("total"))
    step = lambda s, k: F.struct((s["p"] * m / k).alias("p"), (s["total"] + s["p"] * m / k).alias("total"))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), start, step)
    return F.when(m.isNotNull() & (top < 0), 1.0).when(top == 0, 1 - F.exp(-m)).when(top > 0, 1 - walked["total"])


def negative_binomial_tail(line: Column | str, mean: Column | str, size: Column | str) -> Column:
    """P(X > line) of a negative binomial count with a mean and a size (dispersion); null where one of the three is."""
    m, r, top = _c(mean), _c(size), F.floor(_c(line)).cast("int")
    q = m / (m + r)
    first = F.pow(1 - q, r)
    start = F.struct(first.alias("p"), first.alias("total"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * (k - 1 + r) / k * q
        return F.struct(p.alias("p"), (s["total"] + p).alias("total"))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), start, step)
    return F.when(first.isNotNull() & (top < 0), 1.0).when(top == 0, 1 - first).when(top > 0, 1 - walked["total"])


def normal_tail(line: Column | str, mean: Column | str, sd: Column | str) -> Column:
    """P(X > line) of a normal variable. Spark has no error function, so batches of values go through Arrow."""
    @pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore")

    return tail((_c(line) - _c(mean)) / _c(sd))


def binomial_tail(wins: Column | str, n: Column | str, p: float) -> Column:
    """P(at least `wins` of n) at probability p, for rows that are already aggregated; sums in log space."""
    @pandas_udf("double")
    def tail(w: pd.Series, k: pd.Series) -> pd.Series:
        def one(wins: float, n: float) -> float | None:
            if pd.isna(wins) or pd.isna(n):
                return None
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(int(wins), int(n) + 1)]
            top = max(logs, default=0.0)
            return min(1.0, sum(math.exp(x - top) for x in logs) * math.exp(top)) if logs else 0.0

        return pd.Series([one(a, b) for a, b in zip(w, k, strict=True)], dtype="float64")

    return tail(_c(wins), _c(n))


def bankroll_log_return(fraction: Column | str, unit_profit: Column | str) -> Column:
    """log(1 + f * r): sums of it are the logarithm of a bankroll that stakes shares of itself."""
    return F.log(1 + _c(fraction) * _c(unit_profit))
