"""Candidate generation over combinations held as `cols array<int>` (sorted ordinals)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.functions import combos as X
from solekey.session import durable, temporary

# Parts into which the pairs of columns, which all share the empty prefix, are dealt.
PAIR_PARTS = 32


def join_prefixes(kept: DataFrame, parts: int = 1) -> DataFrame:
    """Combinations of equal size that differ in their last column only, joined to one.

    With `parts`, those that share a prefix are dealt by their last column: one side of the join
    is split among so many tasks and the other one copied to each.
    """
    split = kept.select("cols", X.all_but_last(F.col("cols")).alias("prefix"), X.last(F.col("cols")).alias("last"))
    a = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).alias("a")
    b = split.withColumn("part", F.col("last") % parts).alias("b")
    same = (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.part") == F.col("b.part"))
    pairs = a.join(b, same & (F.col("a.last") < F.col("b.last")))
    return pairs.select(F.concat("a.cols", F.array("b.last")).alias("cols"))


def level_pairs(columns: DataFrame) -> DataFrame:
    """All pairs of the given columns (int column `col`)."""
    return join_prefixes(columns.select(F.array(F.col("col").cast("int")).alias("cols")), PAIR_PARTS)


def with_all_subsets(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates all of whose subsets with one column less are among `kept`."""
    subsets = candidates.select("cols", F.explode(X.one_smaller(F.col("cols"))).alias("subset"))
    known = kept.select(F.col("cols").alias("subset")).distinct()
    found = subsets.join(known, "subset").groupBy("cols").agg(F.count(F.lit(1)).alias("found"))
    return found.where(F.col("found") == F.size("cols")).select("cols")


def set_trie(sets: DataFrame) -> DataFrame:
    """(node, column, child, ends): the edges of a trie over sorted combinations.

    A node is the array of columns that leads to it; `ends` marks children that are a whole set.
    """
    size = F.size("cols")
    steps = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            F.slice("cols", 1, i - 1).alias("node"),
            F.element_at("cols", i).alias("column"),
            F.slice("cols", 1, i).alias("child"),
            (i == size).alias("ends"),
        ),
    )
    edges = sets.where(size > 0).select(F.explode(steps).alias("e")).select("e.*")
    return edges.groupBy("node", "column", "child").agg(F.max("ends").alias("ends"))


def containing(candidates: DataFrame, trie: DataFrame) -> DataFrame:
    """(cols): the candidates that contain one of the trie's sets.

    All candidates go down the trie together, a level at a time: from a node along every edge
    whose column is among the rest of the candidate. An edge is found by node and column,
    of which there is one in the trie, so a column that many sets begin with joins no two of
    them; candidates that have met a whole set go no further.
    """
    spark = candidates.sparkSession
    candidates = candidates.select("cols").distinct()
    with temporary(spark) as keep:
        edges = durable(trie)
        depth = edges.agg(F.max(F.size("child"))).first()[0] or 0
        at = candidates.select("cols", F.col("cols").alias("rest"), F.array().cast("array<int>").alias("node"))
        found = []
        for _ in range(depth):
            steps = F.transform(
                F.sequence(F.lit(1), F.size("rest")),
                lambda i: F.struct(F.element_at("rest", i).alias("column"), F.slice("rest", i + 1, F.size("rest")).alias("rest")),
            )
            onward = at.where(F.size("rest") > 0).select("cols", "node", F.explode(steps).alias("s"))
            onward = onward.select("cols", "node", "s.column", "s.rest").join(edges, ["node", "column"])
            onward = durable(onward.select("cols", "rest", F.col("child").alias("node"), "ends"))
            met = onward.where("ends").select("cols").distinct()
            found.append(met)
            at = onward.where("NOT ends").drop("ends").join(met, "cols", "left_anti")
        hits = reduce(DataFrame.unionByName, found).distinct() if found else candidates.limit(0)
        return keep(hits)


def prune_supersets(candidates: DataFrame, uccs: DataFrame) -> DataFrame:
    """Candidates that contain none of the given unique combinations."""
    return candidates.join(containing(candidates, set_trie(uccs.select("cols"))), "cols", "left_anti")


def next_candidates(kept: DataFrame, uccs: DataFrame | None = None) -> DataFrame:
    """The next level from the non-unique combinations of one level, without supersets of `uccs`."""
    joined = with_all_subsets(join_prefixes(kept), kept)
    return joined if uccs is None else prune_supersets(joined, uccs)


def describe(combos: DataFrame, columns: list[str]) -> DataFrame:
    """Public form: ucc (names joined by a comma), columns (names), arity."""
    cols = F.col("cols")
    return combos.select(
        X.label(cols, columns).alias("ucc"), X.names(cols, columns).alias("columns"), F.size(cols).alias("arity")
    )


def undescribe(combos: DataFrame, columns: list[str], name: str = "ucc") -> DataFrame:
    """Adds `cols` to a frame that names its combinations in the public form.

    The names are those in the array `columns` where the frame has it (a name may hold a comma),
    else those in `name`. Unknown names raise an error.
    """
    named = F.col("columns") if dict(combos.dtypes).get("columns") == "array<string>" else F.split(F.col(name), ",")
    return combos.withColumn("cols", X.positions(named, columns))
