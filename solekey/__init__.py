"""Which columns make the rows of a table unique, found with Spark."""

from solekey.operators.bitmaps import cluster_sizes, compress_index, expand_index, intersect_compressed
from solekey.operators.columns import (
    cells,
    column_uniqueness,
    non_unique_columns,
    unique_columns,
    value_clusters,
    value_counts,
)
from solekey.operators.frames import combination_frame, dense_row_id, with_row_id
from solekey.operators.lattice import describe, level_pairs, next_candidates, prune_supersets, undescribe
from solekey.operators.pli import column_index, intersect_pli, single_column_pli
from solekey.operators.quantile import column_medians, exact_median, kth_largest
from solekey.operators.verify import check_combinations
from solekey.plans.search import minimal_uccs
from solekey.session import configure
from solekey.sources.delimited import read_delimited, read_integers, write_delimited

__all__ = [
    "cells",
    "check_combinations",
    "cluster_sizes",
    "column_index",
    "column_medians",
    "column_uniqueness",
    "combination_frame",
    "compress_index",
    "configure",
    "dense_row_id",
    "describe",
    "exact_median",
    "expand_index",
    "intersect_compressed",
    "intersect_pli",
    "kth_largest",
    "level_pairs",
    "minimal_uccs",
    "next_candidates",
    "non_unique_columns",
    "prune_supersets",
    "read_delimited",
    "read_integers",
    "single_column_pli",
    "undescribe",
    "unique_columns",
    "value_clusters",
    "value_counts",
    "with_row_id",
    "write_delimited",
]
