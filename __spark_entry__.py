
from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import solekey as sk
from solekey.functions import combos
from solekey.session import checkpoint_dir, delete

try:
    import corpus_pipeline
    from solekey.llm import queries as training_data
except ModuleNotFoundError as missing:  # only where the package's folders are taken out
    if not missing.name.startswith(("corpus_pipeline", "solekey.llm")):
        raise
    corpus_pipeline = training_data = None

# Columns per table, in table order.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
COLUMNS = {table: names.split() for table, names in COLUMNS.items()}

# Largest combination to look for; None searches the whole lattice.
MAX_ARITY = {table: None for table in COLUMNS}

# Searches with so small a sample that pools, followers and passes over the whole table decide.
# They find the same combinations as those with the usual sample.
SMALL_SAMPLE = 200
SMALL_SAMPLED = ["orders", "events", "customer"]

CHECKED = {
    "lineitem": [
        ["l_orderkey", "l_linenumber"],
        ["l_orderkey", "l_partkey", "l_suppkey"],
        ["l_partkey", "l_suppkey"],
        ["l_returnflag", "l_linestatus"],
        ["l_quantity", "l_discount", "l_tax", "l_shipdate"],
    ],
    "conversations": [["conv_id", "turn"], ["conv_id", "role"], ["text"], ["turn", "role", "text"]],
    "documents": [["lang", "source"], ["text"], ["text", "lang"], ["source", "n_chars"]],
}

# Value texts differ between engines for fractions and times, so only whole numbers and strings.
CLUSTERED = {
    "orders": ["o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "documents": ["text", "lang", "source", "n_chars"],
}

INDEXED = {
    "orders": ("o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "documents": ("doc_id", ["text", "lang", "source", "n_chars"]),
    "events": ("event_id", ["user_id", "event_type", "value", "props"]),
}

INTERSECTED = {
    "orders": ("o_orderkey", ["o_custkey", "o_orderstatus"]),
    "events": ("event_id", ["user_id", "event_type"]),
    "documents": ("doc_id", ["source", "lang", "n_chars"]),
}

# Selections that may sort so few values only that one round does not settle them.
FEW_SORTED = 20

SELECTED = {"lineitem": ("l_extendedprice", 1000), "orders": ("o_totalprice", 77), "events": ("user_id", 5000)}
MEDIANS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
}

COUNTED = ["user_id", "event_type"]

# Tables whose combinations of three columns are pruned by unique ones of any size.
TRIPLES = ["orders", "part"]

# Searches through the columns that rows agree on.
DUAL = ["orders", "part", "events", "lineitem"]

# Pairs and triples of columns that are not unique, as the search would join them.
LATTICE = ["part", "customer", "orders"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession) -> DataFrame:
    """All minimal unique column combinations of orders."""
    return search("orders")(spark, "/root/testdata/sf0.001")


# -- queries ---------------------------------------------------------------------


def search(name: str, max_arity: int | None = None, nulls: str = "equal"):
    return lambda spark, sf_dir: sk.minimal_uccs(table(spark, sf_dir, name), max_arity, nulls).select("ucc", "arity")


def with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nulls in place of the most frequent kind of value in three columns."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") < 300000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


HOLES_SQL = """(SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS o_custkey,
 CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS o_orderstatus,
 CASE WHEN o_totalprice < 300000 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"""


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer: many columns follow from others."""
    return table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )


WIDE_COLUMNS = COLUMNS["orders"] + COLUMNS["customer"]
WIDE_SQL = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


def non_unique_ordinals(df: DataFrame) -> DataFrame:
    """(col): positions of the columns that are not unique by themselves."""
    position = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column_name"))
    return sk.non_unique_columns(sk.column_uniqueness(df)).select((position - 1).cast("int").alias("col"))


def pairs(name: str):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return sk.describe(sk.level_pairs(non_unique_ordinals(df)), df.columns).select("ucc", "arity")

    return run


def level_three(name: str):
    """Pairs are checked; the non-unique ones are joined, without supersets of the unique ones."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        asked = sk.describe(sk.level_pairs(non_unique_ordinals(df)), df.columns)
        verdict = sk.check_combinations(df, [r["columns"] for r in asked.collect()])
        verdict = sk.undescribe(verdict, df.columns).select("cols", "is_unique")
        found = sk.next_candidates(sk.non_unique_columns(verdict), sk.unique_columns(verdict))
        return sk.describe(found, df.columns).select("ucc", "arity")

    return run


def pruned_pairs(name: str):
    """All pairs of columns, without those that contain a unique column."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        stats = sk.column_uniqueness(df)
        position = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column_name"))
        every = sk.level_pairs(stats.select((position - 1).cast("int").alias("col")))
        uniques = sk.undescribe(sk.unique_columns(stats), df.columns, "column_name").select("cols")
        return sk.describe(sk.prune_supersets(every, uniques), df.columns).select("ucc", "arity")

    return run


def pair_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of non-unique columns of part as bit masks, and back to names."""
    df = table(spark, sf_dir, "part")
    masked = sk.level_pairs(non_unique_ordinals(df)).select(combos.to_mask(F.col("cols")).alias("mask"))
    return masked.select(
        "mask", combos.label(combos.from_mask(F.col("mask"), len(df.columns)), df.columns).alias("ucc")
    )


def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sizes of position lists over generated row ids; the ids themselves are arbitrary."""
    df = sk.with_row_id(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"))
    plis = sk.single_column_pli(df, "row_id")
    sizes = plis.groupBy("column_name", "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("column_name", "size").agg(F.count(F.lit(1)).alias("n_clusters"))


def intersected(name: str):
    key, cols = INTERSECTED[name]

    def run(spark, sf_dir):
        plis = sk.single_column_pli(table(spark, sf_dir, name), key, cols)
        return sk.intersect_pli(*[sk.column_index(plis, c) for c in cols])

    return run


def intersected_bitmaps(name: str):
    """The same rows from compressed indexes, of which the first two are met first."""
    key, cols = INTERSECTED[name]

    def run(spark, sf_dir):
        plis = sk.single_column_pli(table(spark, sf_dir, name), key, cols)
        met = reduce(sk.intersect_compressed, [sk.compress_index(sk.column_index(plis, c)) for c in cols])
        return sk.expand_index(met)

    return run


@contextmanager
def scratch(spark: SparkSession):
    """A new folder for text, gone afterwards; what is read from it must be counted before."""
    path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def delimited_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders written as delimited text and read back as a header-less file of strings."""
    chosen = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    with scratch(spark) as path:
        sk.write_delimited(chosen, path, "|")
        return sk.column_uniqueness(sk.read_delimited(spark, path, "|"))


def ragged_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one to three fields, blank ones among them, read back as they are."""
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(""))
        .when(F.col("o_orderkey") % 4 == 1, key)
        .when(F.col("o_orderkey") % 4 == 2, F.concat_ws("|", key, "o_orderstatus"))
        .otherwise(F.concat_ws("|", F.lit(""), "o_orderstatus", "o_orderpriority"))
    )
    with scratch(spark) as path:
        table(spark, sf_dir, "orders").select(line).write.text(path)
        return sk.column_uniqueness(sk.read_delimited(spark, path, "|"))


def carriage_return_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end in a carriage return alone."""
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment")
    with scratch(spark) as path:
        table(spark, sf_dir, "customer").select(line).write.option("lineSep", "\r").text(path)
        return sk.column_uniqueness(sk.read_delimited(spark, path, ";"))


def integers_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three integers per line, read as one set of numbers."""
    fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    with scratch(spark) as path:
        table(spark, sf_dir, "lineitem").select(F.concat_ws(";", *fields)).write.text(path)
        return sk.exact_median(sk.read_integers(spark, path), "value")


def file_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median per field position of a delimited file of integers."""
    chosen = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    with scratch(spark) as path:
        sk.write_delimited(chosen, path, ";")
        fields = sk.read_delimited(spark, path, ";", width=4)
        return sk.column_medians(fields.select(*[F.col(c).cast("int").alias(c) for c in fields.columns]))


def kth(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k-th largest value, or the least one of a smaller table."""
    return sk.kth_largest(df, col, max(1, min(k, df.where(F.col(col).isNotNull()).count())))


def with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with NaN for a third of the rows, more than the median can pass by, nulls and infinities."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, float("nan")).otherwise(price).alias("some_nan"),
        F.when(F.col("l_orderkey") % 5 < 3, float("nan")).otherwise(price).alias("most_nan"),
        F.when(F.col("l_partkey") % 7 == 0, float("-inf"))
        .when(F.col("l_partkey") % 7 == 1, float("inf"))
        .when(F.col("l_partkey") % 7 > 3, price)
        .alias("ends"),
    )


NAN_SQL = """(SELECT CASE WHEN l_orderkey % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice END AS some_nan,
 CASE WHEN l_orderkey % 5 < 3 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice END AS most_nan,
 CASE WHEN l_partkey % 7 = 0 THEN CAST('-inf' AS DOUBLE) WHEN l_partkey % 7 = 1 THEN CAST('inf' AS DOUBLE)
 WHEN l_partkey % 7 > 3 THEN l_extendedprice END AS ends FROM lineitem)"""
NAN_COLUMNS = ["some_nan", "most_nan", "ends"]


def told_apart(df: DataFrame, col: str) -> DataFrame:
    """NaN and infinities as a kind of their own, since they are compared in other ways elsewhere."""
    v = F.col(col)
    kind = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise("number")
    return df.withColumns({"kind": kind, col: F.when(kind == "number", v)})


def told_apart_sql(sql: str, col: str) -> str:
    kind = f"CASE WHEN isnan({col}) THEN 'nan' WHEN isinf({col}) THEN CASE WHEN {col} > 0 THEN 'inf' ELSE '-inf' END ELSE 'number' END"
    return f"SELECT * REPLACE (CASE WHEN {kind} = 'number' THEN {col} END AS {col}), {kind} AS kind FROM ({sql})"


def nan_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and large values of columns with NaN, from rounds that sort only a few values."""
    df = with_nan(spark, sf_dir)
    parts = []
    for c in NAN_COLUMNS:
        parts.append(sk.exact_median(df, c, FEW_SORTED).select(F.lit(c).alias("col"), F.lit(0).alias("k"), "value"))
        for k in NAN_RANKS:
            parts.append(sk.kth_largest(df, c, k, FEW_SORTED).select(F.lit(c).alias("col"), F.lit(k).alias("k"), "value"))
    return told_apart(reduce(DataFrame.unionByName, parts), "value")


NAN_RANKS = [1, 2500]


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered by date, then by key."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return sk.dense_row_id(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderstatus", "row_id")


def pruned_triples(name: str):
    """Three columns each, without those that contain a minimal unique combination of any size."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        every = sk.combination_frame(spark, list(combinations(range(len(df.columns)), 3)))
        known = sk.undescribe(sk.minimal_uccs(df), df.columns).select("cols")
        return sk.describe(sk.prune_supersets(every, known), df.columns).select("ucc", "arity")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator and table it is shown on."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in COLUMNS:
        out[f"minimal_uccs_{name}"] = search(name, MAX_ARITY[name])
        out[f"column_uniqueness_{name}"] = lambda s, d, n=name: sk.column_uniqueness(table(s, d, n))
    for name in SMALL_SAMPLED:
        out[f"minimal_uccs_{name}_small_sample"] = lambda s, d, n=name: sk.minimal_uccs(
            table(s, d, n), sample_rows=SMALL_SAMPLE
        ).select("ucc", "arity")
    out["minimal_uccs_lineitem_arity3"] = search("lineitem", 3)
    out["minimal_uccs_orders_with_customer_arity4"] = lambda s, d: sk.minimal_uccs(
        orders_with_customer(s, d), max_arity=4
    ).select("ucc", "arity")
    out["minimal_uccs_orders_with_customer"] = lambda s, d: sk.minimal_uccs(orders_with_customer(s, d)).select(
        "ucc", "arity"
    )
    out["ragged_text_uniqueness"] = ragged_uniqueness
    out["carriage_return_text_uniqueness"] = carriage_return_uniqueness
    out["minimal_uccs_null_equal"] = lambda s, d: sk.minimal_uccs(with_holes(s, d)).select("ucc", "arity")
    out["minimal_uccs_null_distinct"] = lambda s, d: sk.minimal_uccs(with_holes(s, d), nulls="distinct").select(
        "ucc", "arity"
    )
    out["column_uniqueness_null_equal"] = lambda s, d: sk.column_uniqueness(with_holes(s, d))
    out["column_uniqueness_null_distinct"] = lambda s, d: sk.column_uniqueness(with_holes(s, d), "distinct")
    out["unique_columns_orders"] = lambda s, d: sk.unique_columns(sk.column_uniqueness(table(s, d, "orders")))
    for name, asked in CHECKED.items():
        out[f"check_combinations_{name}"] = lambda s, d, n=name, c=asked: sk.check_combinations(table(s, d, n), c)
    for name, cols in CLUSTERED.items():
        out[f"value_clusters_{name}"] = lambda s, d, n=name, c=cols: sk.value_clusters(table(s, d, n), c)
    out["value_counts_events"] = lambda s, d: sk.value_counts(table(s, d, "events"), COUNTED)
    for name in TRIPLES:
        out[f"prune_supersets_triples_{name}"] = pruned_triples(name)
    for name, (key, cols) in INDEXED.items():
        out[f"single_column_pli_{name}"] = lambda s, d, n=name, k=key, c=cols: sk.single_column_pli(table(s, d, n), k, c)
    for name in INTERSECTED:
        out[f"intersect_pli_{name}"] = intersected(name)
        out[f"intersect_bitmaps_{name}"] = intersected_bitmaps(name)
    for name in LATTICE:
        out[f"level_pairs_{name}"] = pairs(name)
        out[f"next_candidates_{name}"] = level_three(name)
    for name, (col, k) in SELECTED.items():
        out[f"kth_largest_{name}"] = lambda s, d, n=name, c=col, k=k: kth(table(s, d, n), c, k)
        out[f"exact_median_{name}"] = lambda s, d, n=name, c=col: sk.exact_median(table(s, d, n), c)
    for name, cols in MEDIANS.items():
        out[f"column_medians_{name}"] = lambda s, d, n=name, c=cols: sk.column_medians(table(s, d, n), c)
    out["non_unique_columns_orders"] = lambda s, d: sk.non_unique_columns(sk.column_uniqueness(table(s, d, "orders")))
    out["cells_orders"] = lambda s, d: sk.cells(table(s, d, "orders"), CLUSTERED["orders"], "o_orderkey")
    out["prune_supersets_customer"] = pruned_pairs("customer")
    out["prune_supersets_orders"] = pruned_pairs("orders")
    for name in DUAL:
        out[f"minimal_uccs_{name}_dual"] = lambda s, d, n=name: sk.minimal_uccs(
            table(s, d, n), method="dual", sample_rows=SMALL_SAMPLE
        ).select("ucc", "arity")
    out["minimal_uccs_orders_with_customer_dual"] = lambda s, d: sk.minimal_uccs(
        orders_with_customer(s, d), method="dual"
    ).select("ucc", "arity")
    out["selection_nan"] = nan_selection
    out["column_medians_nan"] = lambda s, d: told_apart(sk.column_medians(with_nan(s, d), NAN_COLUMNS), "median")
    out["column_medians_lineitem_narrowed"] = lambda s, d: sk.column_medians(
        table(s, d, "lineitem"), MEDIANS["lineitem"], FEW_SORTED
    )
    out["dense_row_id_orders"] = numbered
    out["combination_masks_part"] = pair_masks
    out["row_ids_customer"] = generated_ids
    out["delimited_text_uniqueness"] = delimited_uniqueness
    out["integer_lines_median"] = integers_median
    out["delimited_text_medians"] = file_medians
    if training_data:
        out |= training_data.QUERIES | {"pipeline": corpus_pipeline.run}
    return out


# -- the same in SQL ---------------------------------------------------------------


# Combinations that one step of the SQL groups.
MASKS_AT_ONCE = 128


def masks(cols: list[str], max_arity: int | None):
    for size in range(1, (max_arity or len(cols)) + 1):
        for combo in combinations(range(len(cols)), size):
            yield sum(1 << i for i in combo), [cols[i] for i in combo]


def ucc_sql(source: str, cols: list[str], max_arity: int | None = None, nulls: str = "equal") -> str:
    """Every combination is grouped; unique ones without a smaller unique one inside remain."""
    every = list(masks(cols, max_arity))
    batches = [every[i : i + MASKS_AT_ONCE] for i in range(0, len(every), MASKS_AT_ONCE)]
    tables = [f"t0 AS MATERIALIZED (SELECT {', '.join(cols)} FROM {source})"]
    for k, batch in enumerate(batches):
        parts = []
        for mask, combo in batch:
            where = " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in combo) if nulls == "distinct" else ""
            parts.append(
                f"SELECT {mask} AS mask, '{','.join(combo)}' AS ucc, {len(combo)} AS arity, NOT EXISTS("
                f"SELECT 1 FROM t{k}{where} GROUP BY {', '.join(combo)} HAVING count(*) > 1) AS u"
            )
        tables.append(f"a{k} AS MATERIALIZED ({' UNION ALL '.join(parts)})")
        # The next batch reads a copy of the table that waits for this one, so that memory stays small.
        if k + 1 < len(batches):
            tables.append(f"t{k + 1} AS MATERIALIZED (SELECT * FROM t0 WHERE (SELECT count(*) FROM a{k}) > 0)")
    found = " UNION ALL ".join(f"SELECT * FROM a{k} WHERE u" for k in range(len(batches)))
    return (
        f"WITH {', '.join(tables)}, k AS MATERIALIZED ({found}) SELECT ucc, CAST(arity AS INTEGER) AS arity FROM k "
        "WHERE NOT EXISTS(SELECT 1 FROM k AS s WHERE s.mask <> k.mask AND (s.mask & k.mask) = s.mask)"
    )


def combo_sql(source: str, combos: list[list[str]], first: str = "ucc", nulls: str = "equal") -> str:
    parts = []
    for combo in combos:
        where = " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in combo) if nulls == "distinct" else ""
        parts.append(
            f"SELECT '{','.join(combo)}' AS {first}, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_distinct, "
            f"CAST(coalesce(max(n), 0) AS BIGINT) AS max_multiplicity, coalesce(max(n), 0) <= 1 AS is_unique "
            f"FROM (SELECT count(*) AS n FROM {source}{where} GROUP BY {', '.join(combo)})"
        )
    return " UNION ALL ".join(parts)


def column_sql(source: str, cols: list[str], nulls: str = "equal") -> str:
    return combo_sql(source, [[c] for c in cols], "column_name", nulls)


def cluster_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cluster_size "
        f"FROM {source} GROUP BY {c} HAVING count(*) > 1"
        for c in cols
    )


def pli_sql(source: str, key: str, cols: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, cluster_id, row_id FROM (SELECT {key} AS row_id, "
        f"min({key}) OVER (PARTITION BY {c}) AS cluster_id, count(*) OVER (PARTITION BY {c}) AS n FROM {source}) WHERE n > 1"
        for c in cols
    ]
    return " UNION ALL ".join(parts)


def intersect_sql(source: str, key: str, cols: list[str]) -> str:
    by = ", ".join(cols)
    return (
        f"SELECT cluster_id, row_id FROM (SELECT {key} AS row_id, min({key}) OVER (PARTITION BY {by}) AS cluster_id, "
        f"count(*) OVER (PARTITION BY {by}) AS n FROM {source}) WHERE n > 1"
    )


def single_sql(source: str, cols: list[str]) -> str:
    """(i, col): columns that repeat."""
    return " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS col WHERE EXISTS(SELECT 1 FROM {source} GROUP BY {c} HAVING count(*) > 1)"
        for i, c in enumerate(cols)
    )


def pairs_sql(source: str, cols: list[str]) -> str:
    return (
        f"WITH c AS ({single_sql(source, cols)}) SELECT a.col || ',' || b.col AS ucc, 2 AS arity "
        "FROM c AS a JOIN c AS b ON a.i < b.i"
    )


def level_three_sql(source: str, cols: list[str]) -> str:
    pair_rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, NOT EXISTS(SELECT 1 FROM {source} GROUP BY {cols[i]}, {cols[j]} HAVING count(*) > 1) AS u"
        for i, j in combinations(range(len(cols)), 2)
    )
    return (
        f"WITH c AS ({single_sql(source, cols)}), p AS ({pair_rows}), "
        "q AS (SELECT p.i, p.j FROM p WHERE NOT u AND i IN (SELECT i FROM c) AND j IN (SELECT i FROM c)) "
        "SELECT a.col || ',' || b.col || ',' || d.col AS ucc, 3 AS arity FROM c AS a JOIN q AS x ON x.i = a.i "
        "JOIN c AS b ON b.i = x.j JOIN q AS y ON y.i = a.i AND y.j > x.j JOIN c AS d ON d.i = y.j "
        "JOIN q AS z ON z.i = x.j AND z.j = y.j"
    )


def median_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(median({c}) AS DOUBLE) AS median FROM {source}" for c in cols
    )


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, cols in COLUMNS.items():
        out[f"minimal_uccs_{name}"] = ucc_sql(name, cols, MAX_ARITY[name])
        out[f"column_uniqueness_{name}"] = column_sql(name, cols)
    orders = COLUMNS["orders"]
    for name in SMALL_SAMPLED:
        out[f"minimal_uccs_{name}_small_sample"] = ucc_sql(name, COLUMNS[name])
    out["minimal_uccs_lineitem_arity3"] = ucc_sql("lineitem", COLUMNS["lineitem"], 3)
    out["minimal_uccs_orders_with_customer_arity4"] = ucc_sql(WIDE_SQL, WIDE_COLUMNS, 4)
    out["minimal_uccs_orders_with_customer"] = ucc_sql(WIDE_SQL, WIDE_COLUMNS)
    ragged = """(SELECT CASE o_orderkey % 4 WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN CAST(o_orderkey AS VARCHAR) END AS c0,
 CASE WHEN o_orderkey % 4 >= 2 THEN o_orderstatus END AS c1, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority END AS c2
 FROM orders)"""
    out["ragged_text_uniqueness"] = column_sql(ragged, ["c0", "c1", "c2"])
    lines = "(SELECT c_custkey AS c0, c_nationkey AS c1, c_mktsegment AS c2 FROM customer)"
    out["carriage_return_text_uniqueness"] = column_sql(lines, ["c0", "c1", "c2"])
    for nulls in ("equal", "distinct"):
        out[f"minimal_uccs_null_{nulls}"] = ucc_sql(HOLES_SQL, orders, nulls=nulls)
        out[f"column_uniqueness_null_{nulls}"] = column_sql(HOLES_SQL, orders, nulls)
    out["unique_columns_orders"] = f"SELECT * FROM ({column_sql('orders', orders)}) WHERE is_unique"
    for name, asked in CHECKED.items():
        out[f"check_combinations_{name}"] = combo_sql(name, [sorted(c, key=COLUMNS[name].index) for c in asked])
    for name, cols in CLUSTERED.items():
        out[f"value_clusters_{name}"] = cluster_sql(name, cols)
    out["value_counts_events"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cluster_size FROM events GROUP BY {c}"
        for c in COUNTED
    )
    for name in TRIPLES:
        triples = ", ".join(f"('{','.join(combo)}')" for combo in combinations(COLUMNS[name], 3))
        out[f"prune_supersets_triples_{name}"] = (
            f"SELECT c.ucc, CAST(3 AS INTEGER) AS arity FROM (VALUES {triples}) AS c(ucc) WHERE NOT EXISTS("
            f"SELECT 1 FROM ({ucc_sql(name, COLUMNS[name])}) AS m "
            "WHERE list_has_all(string_split(c.ucc, ','), string_split(m.ucc, ',')))"
        )
    for name, (key, cols) in INDEXED.items():
        out[f"single_column_pli_{name}"] = pli_sql(name, key, cols)
    for name, (key, cols) in INTERSECTED.items():
        out[f"intersect_pli_{name}"] = out[f"intersect_bitmaps_{name}"] = intersect_sql(name, key, cols)
    for name in LATTICE:
        out[f"level_pairs_{name}"] = pairs_sql(name, COLUMNS[name])
        out[f"next_candidates_{name}"] = level_three_sql(name, COLUMNS[name])
    for name, (col, k) in SELECTED.items():
        out[f"kth_largest_{name}"] = (
            f"SELECT {col} AS value FROM {name} ORDER BY {col} DESC LIMIT 1 OFFSET "
            f"(SELECT greatest(least({k}, count({col})), 1) - 1 FROM {name})"
        )
        out[f"exact_median_{name}"] = f"SELECT quantile_disc({col}, 0.5) AS value FROM {name}"
    for name, cols in MEDIANS.items():
        out[f"column_medians_{name}"] = median_sql(name, cols)
    out["non_unique_columns_orders"] = f"SELECT * FROM ({column_sql('orders', orders)}) WHERE NOT is_unique"
    out["cells_orders"] = " UNION ALL ".join(
        f"SELECT o_orderkey AS row_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders"
        for c in CLUSTERED["orders"]
    )
    for name in ("customer", "orders"):
        pairs_of = ", ".join(f"('{','.join(combo)}')" for combo in combinations(COLUMNS[name], 2))
        out[f"prune_supersets_{name}"] = (
            f"SELECT p.ucc, CAST(2 AS INTEGER) AS arity FROM (VALUES {pairs_of}) AS p(ucc) WHERE NOT EXISTS("
            f"SELECT 1 FROM ({column_sql(name, COLUMNS[name])}) AS u "
            "WHERE u.is_unique AND list_contains(string_split(p.ucc, ','), u.column_name))"
        )
    for name in DUAL:
        out[f"minimal_uccs_{name}_dual"] = out[f"minimal_uccs_{name}"]
    out["minimal_uccs_orders_with_customer_dual"] = out["minimal_uccs_orders_with_customer"]
    selected = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({k} AS INTEGER) AS k, value FROM ({sql})"
        for c in NAN_COLUMNS
        for k, sql in [(0, f"SELECT quantile_disc({c}, 0.5) AS value FROM {NAN_SQL}")]
        + [
            (k, f"SELECT {c} AS value FROM {NAN_SQL} WHERE {c} IS NOT NULL ORDER BY {c} DESC LIMIT 1 OFFSET {k - 1}")
            for k in NAN_RANKS
        ]
    )
    out["selection_nan"] = told_apart_sql(selected, "value")
    out["column_medians_nan"] = told_apart_sql(median_sql(NAN_SQL, NAN_COLUMNS), "median")
    out["column_medians_lineitem_narrowed"] = median_sql("lineitem", MEDIANS["lineitem"])
    out["dense_row_id_orders"] = (
        "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders"
    )
    part = COLUMNS["part"]
    out["combination_masks_part"] = (
        f"WITH c AS ({single_sql('part', part)}) SELECT CAST((1 << a.i) + (1 << b.i) AS BIGINT) AS mask, "
        "a.col || ',' || b.col AS ucc FROM c AS a JOIN c AS b ON a.i < b.i"
    )
    out["row_ids_customer"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, n AS size, count(*) AS n_clusters FROM (SELECT count(*) AS n FROM customer "
        f"GROUP BY {c} HAVING count(*) > 1) GROUP BY n"
        for c in ("c_nationkey", "c_mktsegment")
    )
    text = "(SELECT o_orderkey AS c0, o_custkey AS c1, o_orderstatus AS c2, o_orderpriority AS c3 FROM orders)"
    out["delimited_text_uniqueness"] = column_sql(text, ["c0", "c1", "c2", "c3"])
    out["integer_lines_median"] = (
        "SELECT CAST(quantile_disc(value, 0.5) AS INTEGER) AS value FROM (SELECT l_orderkey AS value FROM lineitem "
        "UNION ALL SELECT l_partkey FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)"
    )
    fields = "(SELECT l_orderkey AS c0, l_partkey AS c1, l_suppkey AS c2, l_linenumber AS c3 FROM lineitem)"
    out["delimited_text_medians"] = median_sql(fields, ["c0", "c1", "c2", "c3"])
    if training_data:
        out |= training_data.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
