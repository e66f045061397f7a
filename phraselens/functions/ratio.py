"""Ratios, bands, thresholds and their display texts.

Ratios that feed a decision are kept as whole thousandths ("milli"): the decision is defined on a
ratio rounded to 0.1 %, and sums of whole numbers do not depend on the order Spark adds them in.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from phraselens.config import (
    ADAPTIVE_THRESHOLDS, BAND_HIGH, BAND_LOW, LOW_CONFIDENCE, PHRASE_THRESHOLD,
)


def _div(a: Column, b: Column) -> Column:
    """Whole-number division; a double quotient would lose digits beyond 2**53."""
    return F.call_function("div", a, b)


def ratio(pos: Column, total: Column) -> Column:
    return F.when(total > 0, pos / total).otherwise(F.lit(0.0))


def ratio_milli(pos: Column, total: Column) -> Column:
    """pos/total in thousandths, halves rounded up; 0 for an empty total."""
    half_up = _div(pos * 2000 + total, total * 2)
    return F.when(total > 0, half_up).otherwise(F.lit(0)).cast("long")


def percent_text(milli: Column) -> Column:
    """'12.3%' for 123 thousandths; exact, because it never passes through a double."""
    return F.concat(_div(milli, F.lit(10)).cast("string"), F.lit("."), (milli % 10).cast("string"), F.lit("%"))


def parse_percent(text: Column) -> Column:
    """0.123 for '12.3%'; null when the text holds no number."""
    return F.regexp_replace(text, "[%\\s]", "").try_cast("double") / 100


def mean_milli(total_milli: Column, n: Column) -> Column:
    """Mean in thousandths, halves rounded up; for display only."""
    return _div(total_milli * 2 + n, n * 2)


def three_decimals(milli: Column) -> Column:
    """'0.123' for 123 thousandths."""
    return F.concat(
        _div(milli, F.lit(1000)).cast("string"), F.lit("."),
        F.lpad((milli % 1000).cast("string"), 3, "0"))


def phrase_band(value: Column) -> Column:
    """Exactly 0.33 is LOW here and NEUTRAL for clusters; the two must not be merged."""
    return F.when(value > BAND_HIGH, "HIGH HATE").when(value > BAND_LOW, "NEUTRAL").otherwise("LOW HATE")


def cluster_band(value: Column) -> Column:
    return F.when(value > BAND_HIGH, "HIGH HATE").when(value < BAND_LOW, "LOW HATE").otherwise("NEUTRAL")


def adaptive_threshold(similarity: Column) -> Column:
    """Ratio a text must exceed, lower the closer its nearest phrase is."""
    *bounded, (_, last) = ADAPTIVE_THRESHOLDS
    case = F
    for below, threshold in bounded:
        case = case.when(similarity < below, F.lit(threshold))
    return case.otherwise(F.lit(last))


def text_verdict(mean: Column, threshold: Column) -> Column:
    return F.when(mean > threshold, "Hate speech detected").otherwise("Non-hate speech")


def phrase_verdict(mean: Column) -> Column:
    return F.when(mean > PHRASE_THRESHOLD, "Hate speech").otherwise("Non-hate speech")


def low_confidence(similarity: Column) -> Column:
    return similarity < LOW_CONFIDENCE


def summary_text(neighbours: int, milli: Column) -> Column:
    return F.concat(
        F.lit("Analysis complete: Input text classified based on semantic similarity to "
              f"{neighbours} nearest phrases (avg hate ratio: "),
        three_decimals(milli), F.lit(")"))
