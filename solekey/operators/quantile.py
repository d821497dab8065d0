"""Exact k-th largest values and medians of any number of values.

One pass over the table builds a quantile sketch of every column; sketches of tasks are
merged, so nothing grows with the table. From it come two values that should lie closely on
both sides of the wanted rank. A second pass counts, exactly, the values below, on and
between them, which tells where the rank lies whatever the sketch's error was. What lies
between is a small share of the table and is read off in a third pass; where that is still
much, it is written and the same is done on it alone.

Order is Spark's: NaN is greater than any number, all NaN are equal, -0.0 equals 0.0. NaN are
counted, not sketched. Nulls are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from solekey.functions.combos import column
from solekey.operators.frames import local_frame
from solekey.session import durable, temporary

# A range of at most this many values is sorted to read off the answer.
FEW_VALUES = 100_000

# Size of a sketch, and how far from the wanted rank it is asked, as a share of the values. Its
# error is below a tenth of a percent nearly always; a miss costs one more round, nothing else.
SKETCH_SIZE = 4096
MARGIN = 0.0015

NAN = float("nan")


@dataclass(frozen=True)
class _Key:
    """A column as the number it is sorted by: a bigint where that loses nothing, else a double."""

    name: str
    dtype: T.DataType

    @property
    def kind(self) -> str:
        return "double" if isinstance(self.dtype, (T.FloatType, T.DoubleType)) or self.is_wide else "bigint"

    @property
    def is_wide(self) -> bool:
        """Several values may have the same key."""
        return isinstance(self.dtype, T.DecimalType) and self.dtype.precision > 18

    @property
    def has_nan(self) -> bool:
        return isinstance(self.dtype, (T.FloatType, T.DoubleType))

    def expr(self) -> Column:
        value = column(self.name)
        if isinstance(self.dtype, T.DecimalType) and not self.is_wide:
            return (value * F.lit(Decimal(10**self.dtype.scale))).cast("long")
        value = value.cast("long" if self.kind == "bigint" else "double")
        return F.when(~F.isnan(value), value) if self.has_nan else value

    def value(self, key: Any) -> Any:
        """The column's value that has the key."""
        if isinstance(self.dtype, T.DecimalType):
            return Decimal(key).scaleb(-self.dtype.scale)
        return key


@dataclass
class _Range:
    """The open interval of a column's keys that holds some wanted ranks (0 is the smallest value)."""

    key: _Key
    ranks: list[int]
    inside: int  # values in the interval
    below: int = 0  # values left of the interval
    low: Any = None
    high: Any = None

    def among(self, v: Column) -> Column:
        """The key where it is in the interval."""
        ok = v.isNotNull()
        if self.low is not None:
            ok = ok & (v > F.lit(self.low))
        if self.high is not None:
            ok = ok & (v < F.lit(self.high))
        return F.when(ok, v)


@dataclass
class _Found:
    """What is known of one column: numbers, NaN, and the keys of its ranks."""

    key: _Key
    numbers: int
    nans: int
    values: dict[int, Any]


def _keys(df: DataFrame, cols: Sequence[str]) -> list[_Key]:
    for c in cols:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"column {c} is not numeric")
    return [_Key(c, df.schema[c].dataType) for c in cols]


def _sketch(v: Column, kind: str) -> Column:
    return getattr(F, f"kll_sketch_agg_{kind}")(v, SKETCH_SIZE)


def _select(
    df: DataFrame, cols: Sequence[str], ranks_of: Callable[[int, int], list[int]], few_values: int | None
) -> list[_Found]:
    """The keys at the ranks that `ranks_of(numbers, nans)` wants of each column."""
    few = FEW_VALUES if few_values is None else few_values
    keys = _keys(df, cols)
    spark = df.sparkSession
    if not keys:
        return []
    sketched = df.agg(
        *[_sketch(k.expr(), k.kind).alias(f"s{i}") for i, k in enumerate(keys)],
        *[F.count_if(F.isnan(column(k.name))).alias(f"n{i}") for i, k in enumerate(keys) if k.has_nan],
        *[F.count(column(k.name)).alias(f"c{i}") for i, k in enumerate(keys)],
    ).first()
    found, open_ranges, sketches = [], [], []
    for i, key in enumerate(keys):
        nans = sketched[f"n{i}"] if key.has_nan else 0
        numbers = sketched[f"c{i}"] - nans
        wanted = sorted(set(ranks_of(numbers, nans)))
        found.append(_Found(key, numbers, nans, {r: NAN for r in wanted if r >= numbers}))
        if inner := [r for r in wanted if r < numbers]:
            open_ranges.append(_Range(key, inner, numbers))
            sketches.append(sketched[f"s{i}"])
    by_key = {f.key: f.values for f in found}

    def exprs(ranges: list[_Range]) -> list[Column]:
        return [r.among(r.key.expr()) for r in ranges]

    frame, of, written = df, exprs, False
    while open_ranges:
        open_ranges = _narrow(frame, open_ranges, of(open_ranges), _cuts(spark, open_ranges, sketches), by_key)
        small = [r for r in open_ranges if r.inside <= few]
        if small:
            _read_off(frame, small, of(small), by_key)
        open_ranges = [r for r in open_ranges if r.inside > few]
        if not open_ranges:
            break
        if not written:
            frame, written = _write(frame, open_ranges, of(open_ranges)), True
            place = {(r.key, r.low, r.high): i for i, r in enumerate(open_ranges)}

            def of(ranges: list[_Range]) -> list[Column]:
                held = [(next(i for (k, low, high), i in place.items() if k == r.key and _within(r, low, high)), r) for r in ranges]
                return [r.among(F.when(F.col("range") == i, F.col(r.key.kind))) for i, r in held]

        row = frame.agg(*[_sketch(v, r.key.kind).alias(str(i)) for i, (r, v) in enumerate(zip(open_ranges, of(open_ranges)))]).first()
        sketches = list(row)
    _refine(df, found)
    return found


def _within(r: _Range, low: Any, high: Any) -> bool:
    return (low is None or (r.low is not None and r.low >= low)) and (high is None or (r.high is not None and r.high <= high))


def _cuts(spark, ranges: list[_Range], sketches: list[bytes]) -> list[tuple[Any, Any]]:
    """For each interval the sketch's values a little before its first and behind its last rank."""
    row = spark.range(1).select(
        *[
            getattr(F, f"kll_sketch_get_quantile_{r.key.kind}")(
                F.lit(bytes(s)),
                F.array(
                    F.lit(max(0.0, (r.ranks[0] - r.below + 0.5) / r.inside - MARGIN)),
                    F.lit(min(1.0, (r.ranks[-1] - r.below + 0.5) / r.inside + MARGIN)),
                ),
            ).alias(str(i))
            for i, (r, s) in enumerate(zip(ranges, sketches))
        ]
    ).first()
    return [tuple(pair) for pair in row]


def _narrow(frame: DataFrame, ranges: list[_Range], exprs: list[Column], cuts, by_key) -> list[_Range]:
    """One pass counts around the cuts; ranks on a cut are settled, the others get a smaller interval."""
    counts = []
    for i, (v, (a, b)) in enumerate(zip(exprs, cuts)):
        tests = {"less": v < F.lit(a), "at_a": v == F.lit(a), "mid": (v > F.lit(a)) & (v < F.lit(b)), "at_b": v == F.lit(b)}
        counts += [F.count_if(test).alias(f"{i}_{name}") for name, test in tests.items()]
    row = frame.agg(*counts).first()
    left: dict[tuple, _Range] = {}
    for i, (r, (a, b)) in enumerate(zip(ranges, cuts)):
        start = r.below
        parts = [(row[f"{i}_less"], (r.low, a)), (row[f"{i}_at_a"], a)]
        if a != b:
            parts += [(row[f"{i}_mid"], (a, b)), (row[f"{i}_at_b"], b)]
        parts.append((r.inside - sum(n for n, _ in parts), (b, r.high)))
        for n, part in parts:
            ranks = [rank for rank in r.ranks if start <= rank < start + n]
            if ranks and not isinstance(part, tuple):
                by_key[r.key] |= dict.fromkeys(ranks, part)
            elif ranks:
                if n >= r.inside:
                    raise RuntimeError(f"selection on {r.key.name} makes no progress")
                left[r.key, part] = _Range(r.key, ranks, n, start, *part)
            start += n
    return list(left.values())


def _exploded(frame: DataFrame, ranges: list[_Range], exprs: list[Column]) -> DataFrame:
    """(range, bigint, double): one row for each value in an interval, the key in the column of its kind."""
    entries = []
    for i, (r, v) in enumerate(zip(ranges, exprs)):
        sides = [v if r.key.kind == kind else F.lit(None).cast(kind) for kind in ("bigint", "double")]
        entries.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("range"), *[s.alias(k) for s, k in zip(sides, ("bigint", "double"))])))
    return frame.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


def _write(frame: DataFrame, ranges: list[_Range], exprs: list[Column]) -> DataFrame:
    return durable(_exploded(frame, ranges, exprs))


def _read_off(frame: DataFrame, ranges: list[_Range], exprs: list[Column], by_key) -> None:
    """Sort what is left of each interval, equal values once, and take the values at the ranks."""
    counted = _exploded(frame, ranges, exprs).groupBy("range", "bigint", "double").count()
    upto = F.sum("count").over(Window.partitionBy("range").orderBy("bigint", "double"))
    wanted = F.array(*[F.array(*[F.lit(rank - r.below).cast("long") for rank in r.ranks]) for r in ranges])
    ranked = counted.withColumn("upto", upto)
    hit = F.exists(F.get(wanted, F.col("range")), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("count")))
    for row in ranked.where(hit).collect():
        r = ranges[row["range"]]
        value = row["bigint"] if r.key.kind == "bigint" else row["double"]
        here = [rank for rank in r.ranks if row["upto"] - row["count"] <= rank - r.below < row["upto"]]
        by_key[r.key] |= dict.fromkeys(here, value)


def _refine(df: DataFrame, found: list[_Found]) -> None:
    """From keys to values; of a wide decimal all values that share the key are sorted."""
    for f in found:
        if not f.key.is_wide:
            f.values = {r: v if v != v else f.key.value(v) for r, v in f.values.items()}
            continue
        for rank, key in f.values.items():
            v = column(f.key.name)
            below = df.agg(F.count_if(f.key.expr() < F.lit(key))).first()[0]
            same = df.where(f.key.expr() == F.lit(key)).groupBy(v.alias("value")).count()
            upto = same.withColumn("upto", F.sum("count").over(Window.orderBy("value")) + F.lit(below))
            f.values[rank] = upto.where((F.col("upto") > rank) & (F.col("upto") - F.col("count") <= rank)).first()["value"]


def _one(df: DataFrame, col: str, ranks_of, few_values: int | None) -> DataFrame:
    with temporary(df.sparkSession):
        (found,) = _select(df.select(column(col)), [col], ranks_of, few_values)
    kind = df.schema[col].dataType.simpleString()
    return local_frame(df.sparkSession, [(v,) for v in found.values.values()], f"value {kind}")


def kth_largest(df: DataFrame, col: str, k: int, few_values: int | None = None) -> DataFrame:
    """The k-th largest value of a numeric column (k = 1 is the maximum), nulls left out.

    few_values sets how many values are sorted at most: it changes the plan, never the answer.
    """

    def ranks(numbers: int, nans: int) -> list[int]:
        n = numbers + nans
        if not 1 <= k <= n:
            raise ValueError(f"k must be between 1 and the {n} values of {col}")
        return [n - k]

    return _one(df, col, ranks, few_values)


def exact_median(df: DataFrame, col: str, few_values: int | None = None) -> DataFrame:
    """The middle value; of the two middle ones of an even number, the smaller. No values, no row."""
    return _one(df, col, lambda numbers, nans: [(numbers + nans - 1) // 2] if numbers + nans else [], few_values)


def column_medians(df: DataFrame, cols: Sequence[str] | None = None, few_values: int | None = None) -> DataFrame:
    """(column_name, median) of numeric columns; the mean of the two middle values for an even count.

    A column without values has a null. All columns share the passes.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cols = list(dict.fromkeys(cols))

    def ranks(numbers: int, nans: int) -> list[int]:
        n = numbers + nans
        return [(n - 1) // 2, n // 2] if n else []

    with temporary(df.sparkSession):
        every = _select(df.select(*[column(c) for c in cols]), cols, ranks, few_values)
    rows = []
    for f in every:
        middle = [float(v) for v in f.values.values()]
        rows.append((f.key.name, sum(middle) / len(middle) if middle else None))
    return local_frame(df.sparkSession, rows, "column_name string, median double")
