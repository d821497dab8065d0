"""Column functions on combinations, kept as sorted arrays of column ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_but_last(cols: Column) -> Column:
    """The prefix two combinations must share to be joined."""
    return F.slice(cols, 1, F.size(cols) - 1)


def last(cols: Column) -> Column:
    return F.element_at(cols, -1)


def one_smaller(cols: Column) -> Column:
    """All combinations that miss exactly one column of this one."""
    return F.transform(cols, lambda c: F.array_remove(cols, c))


def contains(cols: Column, subset: Column) -> Column:
    return F.size(F.array_except(subset, cols)) == 0


def to_mask(cols: Column) -> Column:
    """Bit i set for column i (ordinals up to 62)."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    return F.aggregate(cols, F.lit(0).cast("long"), lambda mask, c: mask.bitwiseOR(bit(c)))


def from_mask(mask: Column, width: int) -> Column:
    ordinals = F.sequence(F.lit(0), F.lit(width - 1))
    return F.filter(ordinals, lambda c: F.getbit(mask, c) == 1)


def names(cols: Column, columns: Sequence[str]) -> Column:
    """Ordinals to column names, in table order."""
    table = F.array(*[F.lit(c) for c in columns])
    return F.transform(cols, lambda c: F.get(table, c))


def label(cols: Column, columns: Sequence[str]) -> Column:
    """Column names joined by a comma, the public name of a combination."""
    return F.array_join(names(cols, columns), ",")


def positions(names: Column, columns: Sequence[str]) -> Column:
    """Column names to ordinals, sorted; a name that is not there is an error."""
    table = F.array(*[F.lit(c) for c in columns])
    unknown = F.concat(F.lit("no such column: "), F.array_join(F.array_except(names, table), ", "))
    ordinals = F.array_sort(F.transform(names, lambda n: (F.array_position(table, n) - 1).cast("int")))
    return F.when(F.size(F.array_except(names, table)) == 0, ordinals).otherwise(
        F.raise_error(unknown).cast("array<int>")
    )
