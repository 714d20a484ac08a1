"""Aggregate expressions with explicit missing-value rules.

Missing is NULL. Every function returns an aggregate ``Column`` that combines on
the map side, so a very large group never has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import day_number


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strict_sum(value, expected: int = 24) -> Column:
    """Sum that is NULL unless exactly ``expected`` values are present."""
    v = _c(value)
    return F.when(F.count(v) == expected, F.sum(v))


def strict_mean(value, expected: int = 24) -> Column:
    v = _c(value)
    return F.when(F.count(v) == expected, F.avg(v))


def complete_sum(value, expected_days) -> Column:
    """Calendar-complete sum: NULL unless there is a value on every expected day."""
    v = _c(value)
    return F.when(F.count(v) == expected_days, F.sum(v))


def paired(x, y) -> tuple[Column, Column]:
    """Both columns, NULL where either is missing."""
    a, b = _c(x), _c(y)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def pearson(x, y) -> Column:
    """Correlation on complete pairs; NULL below two pairs or for a constant side."""
    a, b = paired(x, y)
    return F.when(F.count(a) >= 2,
                  F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def mean_bias(reference, model) -> Column:
    """Mean of model minus reference on complete pairs."""
    return F.avg(_c(model) - _c(reference))


def pair_count(x, y) -> Column:
    a, _ = paired(x, y)
    return F.count(a)


def weighted_mean(value, weight) -> Column:
    """Mean over present cells with positive weight, renormalised."""
    v, w = _c(value), _c(weight)
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def weighted_mean_where(value, weight, condition) -> Column:
    return weighted_mean(F.when(condition, _c(value)), weight)


def valid_fraction(value, weight, total_weight) -> Column:
    """Share of the total positive weight whose cell has a value."""
    v, w = _c(value), _c(weight)
    got = F.coalesce(F.sum(F.when(v.isNotNull() & (w > 0), w)), F.lit(0.0))
    return F.coalesce(F.try_divide(got, total_weight), F.lit(0.0))


def fraction_of_all(condition, weight, total_weight) -> Column:
    """Weighted share of a condition; missing cells count as not fulfilling it."""
    w = _c(weight)
    hit = F.coalesce(F.sum(F.when(condition & (w > 0), w)), F.lit(0.0))
    return F.try_divide(hit, total_weight)


def fraction_of_valid(condition, valid, weight) -> Column:
    """Weighted share of a condition among valid cells."""
    w = _c(weight)
    ok = valid & (w > 0)
    return F.try_divide(F.coalesce(F.sum(F.when(ok & condition, w)), F.lit(0.0)), F.sum(F.when(ok, w)))


def value_on(date, value, on) -> Column:
    """Value of the (unique) row dated ``on``; NULL when absent."""
    return F.max(F.when(_c(date) == on, _c(value)))


def single_value_on(date, value, on) -> Column:
    """As :func:`value_on`, but NULL when several rows carry the date."""
    hit = _c(date) == on
    return F.when(F.count_if(hit) == 1, F.max(F.when(hit, _c(value))))


def peak(value, date) -> Column:
    """Struct ``(v, neg_day)`` of the maximum; ties go to the earliest date."""
    v = _c(value)
    return F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-day_number(date)).alias("neg_day"))))


def peak_date(peak_struct) -> Column:
    return F.date_from_unix_date(-_c(peak_struct).getField("neg_day"))


def group_weighted_mean(mean, n) -> Column:
    """Mean of group means weighted by group size (empty groups ignored)."""
    m, k = _c(mean), _c(n)
    return F.try_divide(F.sum(F.when(k > 0, m * k)), F.sum(F.when(k > 0, k)))


