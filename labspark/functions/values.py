"""Parsing and classification of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labspark.catalog import LABEL_KEYWORDS

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# The three accepted time formats, each with the shape of its texts
TIME_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
)


def to_number(text: Column) -> Column:
    """Number in a string column, null for anything else (the cast alone would take '1d')."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def drop_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def parse_time(text: Column) -> Column:
    """First matching format, null when none matches.

    The shape is tested first: a failed parse costs far more than a failed match.
    """
    return F.coalesce(*[
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
        for form, shape in TIME_FORMATS])


def _range_parts(text: Column) -> Column:
    return F.split(F.translate(F.coalesce(text, F.lit("")), "<>", ""), "-")


def range_low(text: Column) -> Column:
    """Lower bound of '3.5-9.5'; 0 when it cannot be read."""
    return F.coalesce(to_number(_range_parts(text)[0]), F.lit(0.0))


def range_high(text: Column) -> Column:
    """Upper bound of '3.5-9.5'; a single bound counts twice; 100 when it cannot be read."""
    parts = _range_parts(text)
    bound = F.when(F.size(parts) >= 2, to_number(F.get(parts, F.lit(1)))).otherwise(
        to_number(parts[0]) * 2)
    return F.coalesce(bound, F.lit(100.0))


def abnormal_flag(value: Column, low: Column, high: Column,
                  critical_low: Column, critical_high: Column) -> Column:
    """normal / low / high / critical_low / critical_high.

    A missing critical bound stands for the ordinary bound, so such a marker goes straight to
    ``critical_*``.
    """
    return (
        F.when(value > high,
               F.when(value > F.coalesce(critical_high, high), "critical_high").otherwise("high"))
        .when(value < low,
              F.when(value < F.coalesce(critical_low, low), "critical_low").otherwise("low"))
        .otherwise("normal")
    )


def change_rate(first: Column, last: Column) -> Column:
    """(last - first) / first, 0 for a zero start."""
    return F.when(first == 0, F.lit(0.0)).otherwise((last - first) / first)


def direction_of_change(rate: Column) -> Column:
    return F.when(rate > 0.05, "up").when(rate < -0.05, "down").otherwise("stable")


def direction_of_slope(slope: Column) -> Column:
    return F.when(slope > 0.1, "increasing").when(slope < -0.1, "decreasing").otherwise("stable")


def trajectory_label(slope: Column, baseline: Column) -> Column:
    """Subtype from the slope relative to the baseline."""
    rate = slope / baseline
    # Thresholds and labels
    return (
        F.when(baseline <= 0, "数据异常")
        .when(rate > 0.02, "快速恶化/上升亚型")
        .when(rate > 0.005, "缓慢进展亚型")
        .when(rate > -0.005, "平稳控制亚型")
        .when(rate > -0.02, "缓慢改善亚型")
        .otherwise("治疗改善/下降亚型")
    )


def disease_of_label(label: Column, rules: list | None = None) -> Column:
    """Report disease from a prediction label; the first rule with a keyword in it wins."""
    out = F.lit("default")
    for disease, words in reversed(rules or LABEL_KEYWORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.coalesce(label, F.lit("")), F.lit(word))
        out = F.when(hit, disease).otherwise(out)
    return out
