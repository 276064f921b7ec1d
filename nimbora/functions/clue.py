"""A sentence about a place from its percentiles, and a check that it gives nothing away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.config import FEATURES
from nimbora.functions.geo import band

# Phrases by feature, from the lowest percentiles to the highest.
PHRASES = {
    "summer_mean_temp_f": ("cool summers", "mild summers", "warm summers", "hot summers", "very hot summers"),
    "winter_mean_temp_f": ("long, frigid winters", "cold winters", "cool winters", "mild winters", "winters that barely register"),
    "summer_dewpoint_f": ("summer air is bone dry", "summer air is fairly dry", "summer humidity is moderate", "summers are humid", "summers are oppressively humid"),
    "annual_precip_in": ("it is one of the driest places in our table", "it is drier than most of the country", "it gets about average annual precipitation", "it is wetter than most of the country", "it is among the wettest places in our table"),
    "frozen_precip_days_per_year": ("frozen precipitation is essentially unknown", "frozen precipitation is rare", "there are some frozen-precipitation days each winter", "frozen precipitation is frequent in winter", "frozen precipitation is a regular part of winter"),
    "mean_wind_mph": ("winds are calm", "winds are light", "winds are moderate", "it is breezy", "it is persistently windy"),
    "diurnal_temp_range_f": ("almost no day-night temperature swing", "small day-night temperature swings", "typical day-night swings", "large day-night temperature swings", "huge day-night temperature swings"),
    "summer_precip_fraction": ("summers are the dry season", "most rain falls outside summer", "rain is spread through the year", "summer is the wettest season", "rain is heavily concentrated in summer"),
}


def clue() -> Column:
    """The sentence, of a row with the pct_* columns."""
    p = {f: band(F.col(f"pct_{f}"), *phrases) for f, phrases in PHRASES.items()}
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))
    say = F.lit
    return F.concat(
        say("This place has "), p["summer_mean_temp_f"], say(" and "), p["winter_mean_temp_f"], say("; "), p["summer_dewpoint_f"], say(". "),
        cap(p["annual_precip_in"]), say(", and "), p["summer_precip_fraction"], say(". "), cap(p["frozen_precip_days_per_year"]), say(". "),
        cap(p["mean_wind_mph"]), say(", with "), p["diurnal_temp_range_f"], say("."),
    )


def facts() -> Column:
    """What the sentence rests on: feature, label, value, unit, percentile (one decimal), phrase."""
    one = lambda f, ph: F.struct(F.lit(f).alias("feature"), F.lit(FEATURES[f][0]).alias("label"), F.col(f).alias("value"), F.lit(FEATURES[f][1]).alias("unit"), F.round(F.col(f"pct_{f}"), 1).alias("percentile"), band(F.col(f"pct_{f}"), *ph).alias("phrase"))
    return F.array(*[one(f, ph) for f, ph in PHRASES.items()])


def problems(text: Column, tokens: list[Column], values: Column) -> Column:
    """Identity tokens of three characters and more that the text has, and its numbers that are
    neither a value rounded to 0 or 1 decimals nor round to one."""
    low = F.lower(text)
    names = F.transform(F.array(*tokens), lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))))
    told = F.filter(names, lambda t: (F.length(t) >= 3) & F.contains(low, t))
    allowed = F.concat(F.transform(values, lambda v: F.bround(v, 0)), F.transform(values, lambda v: F.bround(v, 1)))
    numbers = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    known = lambda n: F.array_contains(allowed, n) | F.array_contains(allowed, F.rint(n))
    wrong = F.filter(numbers, lambda n: ~F.coalesce(known(n.cast("double")), F.lit(False)))
    return F.concat(F.transform(told, lambda t: F.concat(F.lit("gives away: "), t)), F.transform(wrong, lambda n: F.concat(F.lit("unknown number: "), n)))


def verify(rows: DataFrame, text: str, tokens: list[str], values: Column) -> DataFrame:
    """``rows`` with ``problems`` and ``ok``."""
    return rows.withColumn("problems", problems(F.col(text), [F.col(t) for t in tokens], values)).withColumn("ok", F.size("problems") == 0)
