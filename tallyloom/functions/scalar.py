"""Scalar features (inventory I): arithmetic, text and dates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(col: str) -> Column:
    return F.col(col).cast("double")


def pair_product_ratio(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a*b and a/b (0 when b is 0) for all unordered pairs, in one projection."""
    new = {}
    for a, b in combinations(cols, 2):
        new[f"{a}_x_{b}"] = _d(a) * _d(b)
        new[f"{a}_div_{b}"] = F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.try_divide(_d(a), _d(b)))
    return df.withColumns(new)


def pair_sum(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{a}_plus_{b}": _d(a) + _d(b) for a, b in combinations(cols, 2)})


def ratios(df: DataFrame, triples: Sequence[tuple[str, str, str]], on_bad: float | None = 0.0) -> DataFrame:
    """Listed ratios (name, numerator, denominator); undefined results become ``on_bad``."""
    def one(a: str, b: str) -> Column:
        ratio = F.try_divide(_d(a), _d(b))
        return ratio if on_bad is None else F.coalesce(ratio, F.lit(float(on_bad)))

    return df.withColumns({name: one(a, b) for name, a, b in triples})


def flag(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """0/1 flag; an unknown condition counts as false."""
    return df.withColumn(name, F.coalesce(condition.cast("int"), F.lit(0)))


def concat_pair(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """``a_b`` as text; null when a part is null."""
    return df.withColumn(name or f"{a}_{b}", F.concat(F.col(a).cast("string"), F.lit("_"), F.col(b).cast("string")))


def concat_r(df: DataFrame, cols: Sequence[str], r: int, must_include: str | None = None, max_new: int = 200) -> DataFrame:
    """All r-way text combinations, optionally only those with one column; refuses to add too many."""
    sets = [s for s in combinations(cols, r) if must_include is None or must_include in s]
    if len(sets) > max_new:
        raise ValueError(f"{len(sets)} combinations exceed the limit of {max_new}; stage them in blocks")
    return df.withColumns({"_".join(s): F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in s]) for s in sets})


def int_concat(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """Digits of a and b as one integer; null when the result is not a valid integer."""
    return df.withColumn(name or f"{a}{b}", F.concat(F.col(a).cast("string"), F.col(b).cast("string")).try_cast("bigint"))


def truncate_level(df: DataFrame, cols: Sequence[str], scale: int, suffix: str = "_level") -> DataFrame:
    """Cut numbers to ``1/scale`` steps and use the step number as a category."""
    return df.withColumns({c + suffix: F.floor(_d(c) * scale).cast("bigint").cast("string") for c in cols})


def round_half_even(df: DataFrame, cols: Sequence[str], d: int) -> DataFrame:
    """Round to ``d`` decimals, halves of the scaled value to even."""
    scale = float(10**d)
    return df.withColumns({c: F.rint(_d(c) * scale) / scale for c in cols})


MATH = {
    "log": lambda c: F.when(c > 0, F.log(c)),
    "log1p": lambda c: F.when(c > -1, F.log1p(c)),
    "expm1": F.expm1,
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "square": lambda c: c * c,
    "abs": F.abs,
    "sigmoid_sqrt": lambda c: F.when(c >= 0, 1 / (1 + F.exp(-F.sqrt(c)))),
    "sigmoid": lambda c: 1 / (1 + F.exp(-c)),
}


def math(df: DataFrame, cols: Sequence[str], fn: str) -> DataFrame:
    """Apply a named transform; values outside its domain become null."""
    return df.withColumns({f"{c}_{fn}": MATH[fn](_d(c)) for c in cols})


def power(df: DataFrame, cols: Sequence[str], p: float) -> DataFrame:
    return df.withColumns({f"{c}_pow": F.when(F.col(c) >= 0, F.pow(_d(c), F.lit(p))) for c in cols})


def hinge_power(df: DataFrame, col: str, a: float, b: float, p: float = 0.25) -> DataFrame:
    """(max(x - a, 0) / b) ** p."""
    over = F.when(F.col(col).isNotNull(), F.greatest(_d(col) - F.lit(float(a)), F.lit(0.0)))
    return df.withColumn(f"{col}_hinge", F.pow(over / F.lit(float(b)), F.lit(p)))


def fraction(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """x - floor(x)."""
    return df.withColumn(name or f"{col}_cents", F.col(col) - F.floor(F.col(col)))


def epoch_parts(df: DataFrame, col: str, start: str) -> DataFrame:
    """Month index (12 * year + month) and day number of ``start`` plus a number of seconds."""
    day = F.floor(F.col(col) / 86400)
    at = F.date_add(F.lit(start).cast("date"), day.cast("int"))
    return df.withColumns({f"{col}_month": F.year(at) * 12 + F.month(at), f"{col}_day": day.cast("bigint")})


def subtract_elapsed(df: DataFrame, cols: Sequence[str], seconds_col: str) -> DataFrame:
    """Turn "days ago" columns into absolute day numbers: value minus elapsed whole days."""
    day = F.floor(F.col(seconds_col) / 86400)
    return df.withColumns({c: F.col(c) - day for c in cols})


def entity_id(df: DataFrame, parts: Sequence[str], day: str, age: str, name: str = "uid") -> DataFrame:
    """Synthetic entity key: the parts plus the day the entity started (day minus age)."""
    start = F.floor(_d(day) - _d(age)).cast("bigint").cast("string")
    return df.withColumn(name, F.concat_ws("_", *[F.col(c).cast("string") for c in parts], start))


DATE_PARTS = {
    "day": lambda c, base: F.dayofmonth(c),
    "week": lambda c, base: F.weekofyear(c),
    "month": lambda c, base: F.month(c),
    "year": lambda c, base: F.year(c) - base,
    "week_of_month": lambda c, base: F.ceil(F.dayofmonth(c) / 7).cast("int"),
    "weekday": lambda c, base: F.weekday(c),
    "weekend": lambda c, base: (F.weekday(c) >= 5).cast("int"),
    "quarter": lambda c, base: F.quarter(c),
    "days_in_month": lambda c, base: F.dayofmonth(F.last_day(c)),
    "month_index": lambda c, base: (F.year(c) - base) * 12 + F.month(c) - 1,
    "quarter_index": lambda c, base: (F.year(c) - base) * 4 + F.quarter(c) - 1,
}


def date_parts(df: DataFrame, col: str, parts: Sequence[str], base_year: int = 0) -> DataFrame:
    """Named calendar parts; ``year`` and the indexes count from ``base_year``, weekdays from Monday = 0."""
    day = F.to_date(F.col(col))
    return df.withColumns({f"{col}_{p}": DATE_PARTS[p](day, base_year) for p in parts})


def month_shift(df: DataFrame, col: str, n: int, parts: Sequence[str]) -> DataFrame:
    """Calendar parts of the date ``n`` months away (clamped to the end of the month)."""
    moved = df.withColumn("_moved", F.add_months(F.to_date(F.col(col)), n))
    return moved.withColumns({f"{col}_shift_{p}": DATE_PARTS[p](F.col("_moved"), 0) for p in parts}).drop("_moved")


def days_since(df: DataFrame, col: str, as_of: str) -> DataFrame:
    """Whole days and floor years from the date to a stated day."""
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date(F.col(col)))
    return df.withColumns({f"{col}_days": days, f"{col}_years": F.floor(days / 365).cast("int")})


def parse_suffix(df: DataFrame, col: str, start: int, name: str) -> DataFrame:
    """Integer in the text from a 1-based position on; null when it is not a number."""
    return df.withColumn(name, F.expr(f"substring(`{col}`, {int(start)})").try_cast("bigint"))


def first_character(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.substring(F.col(col), 1, 1))
