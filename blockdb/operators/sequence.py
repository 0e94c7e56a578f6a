"""Dense numbers, running sums and values carried along an order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the ranges of the ordering column that are numbered by themselves.
WIDTH = 4096
BEFORE = (Window.unboundedPreceding, -1)


def running_bases(df: DataFrame, sizes: dict[str, Column], order: str, by: list[str] | None = None, levels: int = 2) -> DataFrame:
    """Adds for each name: size its sum over rows before, in `order` (a distinct integer), within `by`. Null sizes add nothing.

    Ranges of the order are summed apart, the ranges' sums again by ranges of ranges, and only the last sums, WIDTH**levels times fewer, meet in one window.
    """
    by = by or []
    part, inside, whole, before = f"__range{levels}", f"__in{levels}_", f"__sum{levels}_", f"__before{levels}_"
    range_ = F.floor(F.col(order) / WIDTH)
    sums = {n: F.sum(size.cast("long")) for n, size in sizes.items()}
    zero = lambda c: F.coalesce(c, F.lit(0))
    within = Window.partitionBy(*by, part).orderBy(order).rowsBetween(*BEFORE)
    rows = df.withColumn(part, range_).withColumns({inside + n: zero(s.over(within)) for n, s in sums.items()})
    ranges = df.groupBy(*by, range_.alias(part)).agg(*(s.alias(whole + n) for n, s in sums.items()))
    if levels > 1:
        ranges = running_bases(ranges, {before + n: F.col(whole + n) for n in sizes}, part, by, levels - 1)
    else:
        over = Window.partitionBy(*by).orderBy(part).rowsBetween(*BEFORE)
        ranges = ranges.withColumns({before + n: zero(F.sum(whole + n).over(over)) for n in sizes})
    keys = [rows[k].eqNullSafe(ranges[k]) for k in [*by, part]]
    joined = rows.join(ranges.drop(*(whole + n for n in sizes)), keys, "inner")
    return joined.select(*(rows[c] for c in df.columns), *((F.col(before + n) + F.col(inside + n)).cast("long").alias(n) for n in sizes))


def running_base(df: DataFrame, size: Column, order: str, by: list[str] | None = None, name: str = "base", levels: int = 2) -> DataFrame:
    """Adds `name`: the sum of `size` over rows before."""
    return running_bases(df, {name: size}, order, by, levels)


def dense_number(df: DataFrame, order: str, name: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Adds `name`: 1, 2, 3, ... in `order` within `by`."""
    return running_base(df, F.lit(1), order, by, name).withColumn(name, F.col(name) + 1)


def last_before(df: DataFrame, value: Column, order: str, name: str, by: list[str] | None = None, then: str | None = None, width: int = WIDTH, levels: int = 2) -> DataFrame:
    """Adds `name`: the last `value` that is not null of the rows before, in `order` (an integer; ties by `then`) within `by`, or null.

    Each range of the order, `width` wide, passes on its last value, in levels as running sums do.
    """
    by = by or []
    part, inside, end, before = (f"__{x}{levels}" for x in ("range", "in", "end", "before"))
    range_ = F.floor(F.col(order) / width)
    at = F.struct(order, then) if then else F.col(order)
    last = lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(*BEFORE))
    rows = df.withColumn(part, range_)
    rows = rows.withColumn(inside, last(value, Window.partitionBy(*by, part).orderBy(order, *([then] if then else []))))
    ends = df.groupBy(*by, range_.alias(part)).agg(F.max_by(value, F.when(value.isNotNull(), at)).alias(end))
    if levels > 1:
        ends = last_before(ends, F.col(end), part, before, by, levels=levels - 1)
    else:
        ends = ends.withColumn(before, last(F.col(end), Window.partitionBy(*by).orderBy(part)))
    keys = [rows[k].eqNullSafe(ends[k]) for k in [*by, part]]
    joined = rows.join(ends.drop(end), keys, "inner")
    return joined.select(*(rows[c] for c in df.columns), F.coalesce(F.col(inside), F.col(before)).alias(name))


def previous(df: DataFrame, order: str, names: dict[str, str], by: list[str] | None = None, then: str | None = None, width: int = WIDTH) -> DataFrame:
    """Adds for each name: column its value in the row before, in `order` (an integer; ties by `then`) within `by`, or null in the first row."""
    rows = last_before(df, F.struct(*dict.fromkeys(names.values())), order, "__row", by, then, width)
    return rows.select(*df.columns, *(F.col("__row")[c].alias(n) for n, c in names.items()))


def first_rows(df: DataFrame, n: int, order: list[Column], by: list[str], spread: str) -> DataFrame:
    """The first n rows of each group of `by` in `order`. Parts of a group, dealt by the hash of column `spread`, are cut to n first, as many parts as there are shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    for keys in ([*by, "__part"], by):
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= n).drop("__place")
    return rows.drop("__part")
