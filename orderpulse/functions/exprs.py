"""Small column expressions used by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.schemas import DAYS_PER_MONTH


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null when the denominator is zero."""
    return col(num) / F.nullif(col(den), F.lit(0))


def ratio_pos(num: Column | str, den: Column | str) -> Column:
    """num / den, null unless the denominator is positive."""
    d = col(den)
    return col(num) / F.when(d > 0, d)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def truth(c: Column | str) -> Column:
    """Three-valued condition to plain boolean."""
    return F.coalesce(col(c), F.lit(False))


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c))


def add_months_end(c: Column | str, months: int | Column) -> Column:
    """Month end `months` later; the day never spills."""
    return F.last_day(F.add_months(col(c), months))


def month_gap(later: Column | str, earlier: Column | str) -> Column:
    a, b = col(later), col(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def months_to_days(c: Column) -> Column:
    return c * DAYS_PER_MONTH


def entity_id(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys])


def horizon_number(c: Column | str = "horizon") -> Column:
    return F.substring(col(c), 2, 3).cast("int")


def date_array(dates: Iterable[str]) -> Column:
    return F.array(*[F.to_date(F.lit(str(d))) for d in dates])


def explode_dates(df: DataFrame, dates: Iterable[str], not_before: str, name: str) -> DataFrame:
    """Repeat each row for every date in the list that is on or after `not_before`."""
    kept = F.filter(date_array(dates), lambda d: d >= F.col(not_before))
    return df.withColumn(name, F.explode(kept))


def explode_horizons(df: DataFrame, horizons: Iterable[int] = (3, 6, 12)) -> DataFrame:
    return df.withColumn("horizon", F.explode(F.array(*[F.lit(f"H{h}") for h in horizons])))


def case(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching condition wins; a null condition does not match."""
    expr = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr if default is None else expr.otherwise(
        default if isinstance(default, Column) else F.lit(default)
    )


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def labels_where(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.filter(
        F.array(*[F.when(truth(cond), F.lit(label)) for cond, label in pairs]),
        lambda x: x.isNotNull(),
    )


def nudge(digits: int) -> float:
    """A shift far below the last digit: half-way cases, which sums taken in another order may leave on either
    side, all fall on the upper one."""
    return 1.3 * 10.0 ** -(digits + 3)


def round_all(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double column; used at the edge so that sums taken in another order compare equal."""
    return df.selectExpr(
        *[f"round(`{n}` + {nudge(digits)!r}D, {digits}) as `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes]
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a null key meets a null key; the right keys are dropped."""
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    cond = all_of([F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on])
