"""Ingest and feature expressions: casts, text parsing, codes, guarded ratios, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def code_flags(code: Column | str, groups: dict[str, list[str]]) -> dict[str, Column]:
    """One boolean per group: whether the lower-cased code is in its set; null codes are in none."""
    low = F.lower(_c(code))
    return {name: F.coalesce(low.isin(*values), F.lit(False)) for name, values in groups.items()}


def safe_int(col: Column | str) -> Column:
    """Whole number of a text, null if it has none."""
    return _c(col).try_cast("double").try_cast("long")


def safe_float(col: Column | str, digits: int = 3) -> Column:
    value = F.nanvl(_c(col).try_cast("double"), F.lit(None).cast("double"))
    return F.round(value, digits)


def split_pair(col: Column | str, mark: str = "-") -> tuple[Column, Column]:
    """Both numbers of a text such as 7-15; null where a side is missing or not a number."""
    parts = F.split(_c(col), mark)
    return F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")


def feet_inches(col: Column | str) -> Column:
    feet, inches = split_pair(col)
    return feet * 12 + inches


def clock_seconds(col: Column | str) -> Column:
    """Seconds of a mm:ss text."""
    minutes, seconds = split_pair(col, ":")
    return minutes * 60 + seconds


def score_margin(col: Column | str) -> Column:
    return F.when(F.upper(_c(col)) == "TIE", F.lit(0)).otherwise(_c(col).try_cast("int"))


def wind_speed(col: Column | str) -> Column:
    return F.regexp_extract(F.lower(_c(col)), r"(\d+)\s*mph", 1).try_cast("int")


def innings_to_outs(ip: Column | str) -> Column:
    """Outs of innings notation: 6.2 are six innings and two outs."""
    x = _c(ip).cast("double")
    return (F.floor(x) * 3 + F.round((x - F.floor(x)) * 10)).cast("long")


def true_innings(ip: Column | str) -> Column:
    return innings_to_outs(ip) / 3


def safe_div(num: Column | str, den: Column | str, min_den: float = 1) -> Column:
    """num / den where den is at least min_den, else null."""
    return F.when(_c(den) >= min_den, _c(num).cast("double") / _c(den))


def in_window(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows with start <= day < end."""
    return df.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date")))


def map_codes(code: Column | str, table: dict, default=None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _c(code))
    return found if default is None else F.coalesce(found, F.lit(default))


def effective_hand(bats: Column | str, throws: Column | str) -> Column:
    """Side a batter stands on: switch hitters stand opposite the pitcher."""
    b, t = _c(bats), _c(throws)
    return F.when(b == "S", F.when(t == "L", "R").when(t == "R", "L")).otherwise(b)


def platoon_advantage(bats: Column | str, throws: Column | str) -> Column:
    return (effective_hand(bats, throws) != _c(throws)).cast("int")


# Venues whose roof is closed.
DOME_VENUES = (
    "rogers centre",
    "tropicana field",
    "minute maid park",
    "globe life field",
    "chase field",
    "t-mobile park",
    "american family field",
    "loandepot park",
    "miller park",
)


def weather_flags(text: Column | str, venue: Column | str | None = None) -> dict[str, Column]:
    """Flags of a weather text. A game is indoors by its venue, by a dome or roof in the text, or where the wind is `none.`."""
    low = F.lower(_c(text))
    wind = F.when(low.startswith("out to"), 1).when(low.startswith("in from"), -1).when(low.isin("none.", "calm."), 0)
    dome = low.contains("dome") | low.contains("roof") | (low == "none.")
    if venue is not None:
        place = F.lower(_c(venue).cast("string"))
        held = F.lit(False)
        for name in DOME_VENUES:
            held = held | place.contains(name)
        dome = F.coalesce(held, F.lit(False)) | F.coalesce(dome, F.lit(False))
    return {"is_dome": dome, "wind_score": wind, "is_clear": low.startswith("clear") | low.startswith("sunny"), "has_rain": low.rlike("rain|drizzle|shower")}


def season_phase(day: Column | str) -> Column:
    m = F.month(_c(day))
    return F.when(m <= 4, "early").when(m <= 7, "middle").otherwise("late")


def spray_labels(x: Column | str, y: Column | str, hand: Column | str, pull_from: float = 15.0, x0: float = 125.0, y0: float = 199.0) -> dict[str, Column]:
    """Angle from home plate through second base, in degrees, and whether the ball was pulled or went the other way."""
    angle = F.degrees(F.atan2(_c(x) - x0, y0 - _c(y)))
    signed = F.when(_c(hand) == "L", -angle).otherwise(angle)
    return {"spray_angle": angle, "pulled": signed < -pull_from, "opposite": signed > pull_from}


def weighted_metric(shares: list[Column], metrics: list[Column], fallbacks: list[Column] | None = None) -> Column:
    """Sum of share times metric over the sum of shares, of the kinds that have both; a missing metric takes its fallback."""
    fallbacks = fallbacks or [F.lit(None).cast("double")] * len(metrics)
    total, weight = F.lit(0.0), F.lit(0.0)
    for share, metric, fallback in zip(shares, metrics, fallbacks, strict=True):
        value = F.coalesce(metric, fallback)
        there = share.isNotNull() & value.isNotNull() & (share > 0)
        total += F.when(there, share * value).otherwise(0.0)
        weight += F.when(there, share).otherwise(0.0)
    return F.when(weight > 0, total / weight)


#: Plate appearances to be expected in each place of the batting order.
SLOT_PA = {1: 4.6, 2: 4.5, 3: 4.4, 4: 4.3, 5: 4.2, 6: 4.1, 7: 4.0, 8: 3.9, 9: 3.8}


def expected_pa(slot: Column | str, ip_per_start: Column | str) -> dict[str, Column]:
    """Plate appearances of a slot, those against the starter, and the bullpen's share of them."""
    total = map_codes(slot, SLOT_PA)
    starter = _c(ip_per_start) * 4.0 / 9.0
    share = F.when(total.isNotNull() & starter.isNotNull(), F.greatest(F.lit(0.0), total - starter) / total)
    return {"total_pa": total, "starter_pa": starter, "bullpen_share": share}


def total_bases(hits: str, doubles: str, triples: str, homers: str) -> Column:
    return F.col(hits) + F.col(doubles) + 2 * F.col(triples) + 3 * F.col(homers)


def over_line(value: Column | str, line: float) -> Column:
    """1 over, 0 under, null if the value is unknown."""
    return (_c(value) > line).cast("int")


def differentials(df: DataFrame, columns: list[tuple[str, bool]], home: str = "home_", away: str = "away_", out: str = "diff_") -> DataFrame:
    """Home less away of each column, the other way round where lower is better."""
    made = {out + c: (F.col(away + c) - F.col(home + c)) if invert else (F.col(home + c) - F.col(away + c)) for c, invert in columns}
    return df.withColumns(made)


def feature_columns(df: DataFrame, prefixes: list[str]) -> list[str]:
    """Numeric columns with one of the prefixes, each name once, in order."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    kept = [c for c, kind in df.dtypes if c.startswith(tuple(prefixes)) and (kind in numeric or kind.startswith("decimal"))]
    return list(dict.fromkeys(kept))


def ladder(df: DataFrame, stat: str, rungs: list[float]) -> DataFrame:
    """Every row once per rung with y = stat > rung; nothing is shuffled."""
    out = df.withColumn("rung", F.explode(F.array(*[F.lit(float(r)) for r in rungs])))
    return out.withColumn("y", (F.col(stat) > F.col("rung")).cast("int"))


def zscore(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Each column less its mean over its sample deviation; the moments are one row."""
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    joined = df.join(F.broadcast(moments))
    made = {c + suffix: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")) for c in columns}
    return joined.withColumns(made).select(*df.columns, *made)


def crosses(df: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """All products of one column of a and one of b."""
    return df.withColumns({f"{x}_x_{y}": F.col(x) * F.col(y) for x in a for y in b})


def clump_filter(df: DataFrame, p: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(p).between(low, high))


def four_factors(fgm: Column, fga: Column, fg3m: Column, fta: Column, orb: Column, tov: Column, points: Column) -> dict[str, Column]:
    possessions = fga + 0.44 * fta - orb + tov
    return {
        "possessions": possessions,
        "off_eff": safe_div(100 * points, possessions),
        "efg": safe_div(fgm + 0.5 * fg3m, fga),
        "tov_pct": safe_div(tov, fga + 0.44 * fta + tov),
        "ft_rate": safe_div(fta, fga),
    }


def baseball_rates(**c: Column) -> dict[str, Column]:
    """Rates from counts h, d, t, hr, bb, hbp, so, ab, sf, ip (true innings), ha, bba, hra, soa."""
    ab, pa = c["ab"], c["ab"] + c["bb"] + c["hbp"] + c["sf"]
    singles = c["h"] - c["d"] - c["t"] - c["hr"]
    bases = singles + 2 * c["d"] + 3 * c["t"] + 4 * c["hr"]
    avg, obp, slg = safe_div(c["h"], ab), safe_div(c["h"] + c["bb"] + c["hbp"], pa), safe_div(bases, ab)
    woba = safe_div(0.69 * c["bb"] + 0.72 * c["hbp"] + 0.89 * singles + 1.27 * c["d"] + 1.62 * c["t"] + 2.1 * c["hr"], pa)
    ip = c["ip"]
    fip = F.when(ip > 0, (13 * c["hra"] + 3 * c["bba"] - 2 * c["soa"]) / ip + 3.1)
    return {"avg": avg, "obp": obp, "slg": slg, "ops": obp + slg, "iso": slg - avg, "woba": woba, "fip": fip, "k9": F.when(ip > 0, 9 * c["soa"] / ip), "whip": F.when(ip > 0, (c["bba"] + c["ha"]) / ip)}


def json_number(col: Column | str, path: str, per: Column | str | None = None) -> Column:
    value = F.get_json_object(_c(col), path).try_cast("double")
    return value if per is None else F.when(_c(per) > 0, value / _c(per))


def local_time(ts: Column | str, zone: str) -> dict[str, Column]:
    """Local date and hour of a UTC timestamp."""
    local = F.from_utc_timestamp(_c(ts).cast("timestamp"), zone)
    return {"local_date": F.to_date(local), "local_hour": F.hour(local)}


def display_key(*columns: str) -> Column:
    """Readable key for display; joins use the columns themselves."""
    return F.concat_ws("|", *columns)


def box_order(df: DataFrame, group: str, order: str) -> DataFrame:
    """Place in the group, whether first in it, from the order of rows."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("slot", F.row_number().over(w)).withColumn("is_first", (F.col("slot") == 1).cast("int"))


def decision_tag(note: Column | str) -> Column:
    n = _c(note)
    return F.when(n.rlike(r"\(W"), "W").when(n.rlike(r"\(L"), "L").when(n.rlike(r"\(S"), "S").when(n.rlike(r"\(H"), "H")


def pair_home_away(df: DataFrame, game: str, matchup: str, columns: list[str]) -> DataFrame:
    """One row per game from its two team rows; the home row's matchup text has "vs.", the away row's "@". Other games are left out."""
    home, away = F.col(matchup).contains("vs."), F.col(matchup).contains("@")
    made = [F.max(F.when(side, F.col(c))).alias(f"{name}_{c}") for name, side in (("home", home), ("away", away)) for c in columns]
    counts = [F.count("*").alias("_n"), F.count_if(home).alias("_h"), F.count_if(away).alias("_a")]
    return df.groupBy(game).agg(*made, *counts).where("_n = 2 AND _h = 1 AND _a = 1").drop("_n", "_h", "_a")
