import random
from collections import Counter
from decimal import Decimal

import pytest
from brute import group_counts
from pyspark.sql import functions as F

import solekey as sk
from solekey.functions import codes, combos
from solekey.operators import pli as pli_module
from solekey.operators import lattice, quantile
from solekey.plans.coded import code_table


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(11)
    rows = []
    for i in range(250):
        city = "metro" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        rows.append((i, city, rng.choice([1.5, 2.5, 0.0, -0.0, float("nan"), None]), rng.randrange(30), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "id int, city string, score double, age int, flag boolean").repartition(3)
    return rows, df.persist()


def same_value(v):
    return "nan" if isinstance(v, float) and v != v else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("nulls", ["equal", "distinct"])
def test_column_uniqueness(people, nulls):
    rows, df = people
    rows = [tuple(same_value(v) for v in r) for r in rows]
    expected = []
    for c, name in enumerate(df.columns):
        counts = group_counts(rows, (c,), nulls)
        expected.append((name, sum(counts.values()), len(counts), max(counts.values()), max(counts.values()) == 1))
    assert rows_of(sk.column_uniqueness(df, nulls)) == sorted(expected, key=repr)


def test_unique_and_other_columns(people):
    stats = sk.column_uniqueness(people[1])
    assert [r.column_name for r in sk.unique_columns(stats).collect()] == ["id"]
    assert sorted(r.column_name for r in sk.non_unique_columns(stats).collect()) == ["age", "city", "flag", "score"]


@pytest.mark.parametrize("nulls", ["equal", "distinct"])
def test_check_combinations(people, nulls):
    rows, df = people
    rows = [tuple(same_value(v) for v in r) for r in rows]
    asked = [("city", "age"), ("score", "age", "flag"), ("id", "city"), ("age",), ("city", "score", "age", "flag")]
    expected = []
    for combo in asked:
        counts = group_counts(rows, [df.columns.index(c) for c in combo], nulls)
        most = max(counts.values())
        expected.append((",".join(combo), sum(counts.values()), len(counts), most, most == 1))
    assert rows_of(sk.check_combinations(df, asked, nulls)) == sorted(expected, key=repr)


def test_check_combinations_rejects_bad_input(people):
    for bad in ([("nope",)], [()], [("id", "id")]):
        with pytest.raises(ValueError):
            sk.check_combinations(people[1], bad)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows_of(sk.column_uniqueness(df)) == [("a", 0, 0, 0, True), ("b", 0, 0, 0, True)]
    assert rows_of(sk.check_combinations(df, [("a", "b")])) == [("a,b", 0, 0, 0, True)]


def weak(value, slot):
    """Few codes per slot, so that different values often share one."""
    return F.when(value.isNotNull(), F.pmod(F.shiftright(F.xxhash64(value), 16 * slot), F.lit(64)))


def test_colliding_codes_are_noticed_and_extended(spark):
    rows = [(f"v{i % 90}", f"w{i if i > 2 else 0}") for i in range(200)]
    df = spark.createDataFrame(rows, "often string, rare string")
    table = code_table(df, hasher=weak)
    assert all(len(s) > 1 for s in table.slots)
    assert [s.groups for s in table.single] == [90, 198]
    assert table.counts([(0, 1)], False)[(0, 1)].groups == len(set(rows))


def test_collisions_that_never_end_are_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "x string")
    with pytest.raises(RuntimeError, match="one-to-one"):
        code_table(df, hasher=lambda value, slot: F.when(value.isNotNull(), F.lit(1).cast("long")))


def test_codes_of_every_type(spark):
    df = spark.sql(
        """select cast(id % 3 as tinyint) a, id % 2 = 0 b, date_add(date'2020-01-01', cast(id % 4 as int)) c,
           timestamp_micros(id % 5) d, cast(id % 6 as decimal(30, 2)) e, cast(id % 7 as decimal(9, 2)) f,
           array(cast(id % 8 as float)) g, struct(id % 9 as x, 'q' as y) h, cast(cast(id % 10 as string) as binary) i,
           cast(id % 11 as float) j, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % 12 as int)) k,
           make_dt_interval(cast(id % 13 as int)) l, make_ym_interval(cast(id % 14 as int)) m, void n
           from (select id, null as void from range(200))"""
    )
    stats = {r.column_name: r.n_distinct for r in sk.column_uniqueness(df).collect()}
    assert stats == dict(zip("abcdefghijklm", [3, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14])) | {"n": 1}
    assert codes.needs_proof(df.schema["e"].dataType) and not codes.needs_proof(df.schema["f"].dataType)


def test_cells_and_values(people):
    rows, df = people
    cells = sk.cells(df, ["city", "age"], row_id_col="id")
    assert cells.columns == ["row_id", "column_name", "value"] and cells.count() == 500
    counts = Counter(("city", r[1]) for r in rows) + Counter(("age", str(r[3])) for r in rows)
    assert rows_of(sk.value_counts(df, ["city", "age"])) == sorted(((*k, n) for k, n in counts.items()), key=repr)
    assert rows_of(sk.value_clusters(df, ["city", "age"])) == sorted(((*k, n) for k, n in counts.items() if n > 1), key=repr)


def test_value_clusters_of_rarely_repeated_texts(spark):
    rows = [(f"text {i % 97}" if i < 100 else f"other {i}", i % 3) for i in range(400)] + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "body string, n int")
    counts = Counter(("body", r[0]) for r in rows) + Counter(("n", str(r[1])) for r in rows)
    expected = sorted(((*k, n) for k, n in counts.items() if n > 1), key=repr)
    assert rows_of(sk.value_clusters(df)) == expected


def brute_pli(rows, cols):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[c] for c in cols), []).append(r[0])
    return sorted((min(ids), i) for ids in groups.values() if len(ids) > 1 for i in ids)


@pytest.mark.parametrize("hot_clusters", [1000, 2])
def test_position_lists(people, monkeypatch, hot_clusters):
    monkeypatch.setattr(pli_module, "HOT_CLUSTERS", hot_clusters)
    rows, df = people
    plis = sk.single_column_pli(df, "id", ["city", "age", "flag"]).persist()
    index = {c: sk.column_index(plis, c) for c in ("city", "age", "flag")}
    for name, col in (("city", 1), ("age", 3), ("flag", 4)):
        assert rows_of(index[name]) == sorted(brute_pli(rows, [col]), key=repr)
    assert rows_of(sk.intersect_pli(index["city"], index["age"])) == sorted(brute_pli(rows, [1, 3]), key=repr)
    three = sk.intersect_pli(index["city"], index["age"], index["flag"])
    assert rows_of(three) == sorted(brute_pli(rows, [1, 3, 4]), key=repr)
    again = sk.intersect_pli(sk.intersect_pli(index["city"], index["age"]), index["flag"])
    assert rows_of(again) == rows_of(three)


def test_empty_intersection_means_unique(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "id int, p string, q string")
    plis = sk.single_column_pli(df, "id")
    assert sk.intersect_pli(sk.column_index(plis, "p"), sk.column_index(plis, "q")).isEmpty()


def test_row_ids_are_fixed(spark):
    df = sk.with_row_id(spark.range(50).select(F.rand().alias("x")).repartition(3))
    first = rows_of(df)
    assert len({r[1] for r in first}) == 50 and rows_of(df) == first


def test_lattice_steps(spark):
    pairs = sk.level_pairs(spark.createDataFrame([(2,), (0,), (5,)], "col int"))
    assert rows_of(pairs) == [([0, 2],), ([0, 5],), ([2, 5],)]
    level = sk.combination_frame(spark, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (0, 3)])
    assert rows_of(sk.next_candidates(level)) == [([0, 1, 2],), ([0, 1, 3],), ([0, 2, 3],), ([1, 2, 3],)]
    assert rows_of(sk.next_candidates(level, sk.combination_frame(spark, [(1, 3)]))) == [([0, 1, 2],), ([0, 2, 3],)]
    missing = sk.combination_frame(spark, [(0, 1), (0, 2)])
    assert rows_of(sk.next_candidates(missing)) == []
    named = sk.describe(level, ["a", "b", "c", "d"]).first()
    assert tuple(named) == ("a,b", ["a", "b"], 2)
    back = sk.undescribe(sk.describe(level, ["a", "b", "c", "d"]), ["a", "b", "c", "d"]).select("cols")
    assert rows_of(back) == rows_of(level)


def test_prune_supersets_matches_sets(spark):
    rng = random.Random(1)
    cands = {tuple(sorted(rng.sample(range(9), 4))) for _ in range(60)}
    uccs = [(1,), (2, 5), (0, 3, 4), (6, 7, 8)]
    kept = sk.prune_supersets(sk.combination_frame(spark, cands), sk.combination_frame(spark, uccs))
    expected = [(list(c),) for c in cands if not any(set(u) <= set(c) for u in uccs)]
    assert rows_of(kept) == sorted(expected, key=repr)


def test_masks(spark):
    df = sk.combination_frame(spark, [(0, 3), (62,), (1, 2, 40)])
    out = df.select("cols", combos.to_mask(F.col("cols")).alias("m")).collect()
    assert [r.m for r in out] == [sum(1 << c for c in r.cols) for r in out]
    back = df.select("cols", combos.from_mask(combos.to_mask(F.col("cols")), 63).alias("back"))
    assert all(list(r.cols) == list(r.back) for r in back.collect())


def kth(values, k):
    return sorted(values, reverse=True)[k - 1]


VALUE_SETS = {
    "repeats": [5] * 400 + [7] * 300 + list(range(300)),
    "two": [1, 2] * 300,
    "one": [4] * 500,
    "spread": [(i * 7919) % 100_003 for i in range(900)],
    "big": [2**62 + i for i in range(600)] + [2**62] * 200,
    "far apart": [-(2**63) + i for i in range(200)] + [2**63 - 1 - i for i in range(200)],
    "single": [9],
}


def coarse(monkeypatch):
    """A sketch so coarse that ranks are missed, and next to nothing sorted."""
    monkeypatch.setattr(quantile, "SKETCH_SIZE", 8)
    monkeypatch.setattr(quantile, "FEW_VALUES", 3)


@pytest.mark.parametrize("name", VALUE_SETS)
@pytest.mark.parametrize("few", [3, 100_000])
def test_selection(spark, monkeypatch, name, few):
    if few == 3:
        coarse(monkeypatch)
    values = VALUE_SETS[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint").coalesce(2).persist()
    k = len(values) // 3 + 1
    assert sk.kth_largest(df, "v", k).first().value == kth(values, k)
    assert sk.exact_median(df, "v").first().value == sorted(values)[(len(values) - 1) // 2]


def spark_order(v):
    return (v != v, 0.0 if v != v else v)


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_with_nan_and_infinities(spark, monkeypatch, seed):
    coarse(monkeypatch)
    rng = random.Random(seed)
    nan, inf = float("nan"), float("inf")
    values = [rng.choice([nan, nan, inf, -inf, -0.0, 0.0, rng.gauss(0, 1), round(rng.gauss(0, 3))]) for _ in range(1500)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "v double").coalesce(2).persist()
    ordered = sorted(values, key=spark_order, reverse=True)
    nans = sum(v != v for v in values)
    for k in (1, nans, nans + 1, nans + 2, 700, len(values) - 200, len(values) - 1, len(values)):
        got, expected = sk.kth_largest(df, "v", k).first().value, ordered[k - 1]
        assert got == expected or (got != got and expected != expected)
    assert same_value(sk.exact_median(df, "v").first().value) == same_value(sorted(values, key=spark_order)[(len(values) - 1) // 2])


def test_medians_of_nan_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, nan, 1.0, inf), (nan, 2.0, nan, inf), (nan, 4.0, 3.0, 1.0), (nan, 1.0, nan, -inf)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {r.column_name: r.median for r in sk.column_medians(df).collect()}
    assert got["a"] != got["a"] and got["b"] == 3.0 and got["c"] != got["c"] and got["d"] == inf
    floats = df.select(F.col("b").cast("float").alias("b"))
    assert sk.kth_largest(floats, "b", 2).first().value == 4.0


@pytest.mark.parametrize("kind", ["decimal(9,2)", "decimal(18,6)", "decimal(38,10)"])
def test_selection_of_decimals(spark, monkeypatch, kind):
    coarse(monkeypatch)
    scale = int(kind[:-1].split(",")[1])
    unscaled = [10**17 + i // 3 for i in range(200)] if "38" in kind else [i * 37 % 211 - 100 for i in range(400)]
    values = [Decimal(v).scaleb(-scale) for v in unscaled]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    assert sk.kth_largest(df, "v", 90).first().value == kth(values, 90)
    assert sk.exact_median(df, "v").first().value == sorted(values)[(len(values) - 1) // 2]


def test_median_of_even_and_empty(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int")
    assert sk.exact_median(df, "v").first().value == 2
    assert sk.exact_median(df.where("v > 99"), "v").isEmpty()
    with pytest.raises(ValueError):
        sk.kth_largest(df, "v", 5)
    with pytest.raises(TypeError):
        sk.kth_largest(df.select(F.col("v").cast("string").alias("v")), "v", 1)


@pytest.mark.parametrize("few", [4, 100_000])
def test_column_medians(spark, monkeypatch, few):
    if few == 4:
        coarse(monkeypatch)
    rows = [(i % 13, float(i) / 4, None, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, c bigint, d string")
    got = {r.column_name: r.median for r in sk.column_medians(df).collect()}
    exact = df.agg(F.median("a"), F.median("b")).first()
    assert got == {"a": exact[0], "b": exact[1], "c": None}


def test_medians_of_many_columns_take_three_passes(spark, monkeypatch):
    passes = []
    for name in ("_narrow", "_read_off"):
        own = getattr(quantile, name)
        monkeypatch.setattr(quantile, name, lambda *a, f=own, n=name: passes.append(n) or f(*a))
    df = spark.range(200_000).selectExpr(*[f"id * {k} % 99991 AS c{k}" for k in range(1, 8)])
    got = {r.column_name: r.median for r in sk.column_medians(df).collect()}
    assert got == {f"c{k}": m for k, m in zip(range(1, 8), df.agg(*[F.median(f"c{k}") for k in range(1, 8)]).first())}
    assert passes.count("_narrow") == 1 and passes.count("_read_off") <= 1


def test_dense_row_ids(spark):
    rows = [(i * 7919 % 500, None if i % 50 == 0 else i // 25, f"t{i}") for i in range(500)]
    rows = [(a, b, t) for a, b, t in rows if b is not None or a % 3 == 0]
    df = spark.createDataFrame(rows, "a int, b int, `t.x` string").repartition(7)
    got = {r[2]: r.row_id for r in sk.dense_row_id(df, ["b", "a"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {t: i for i, (_, _, t) in enumerate(ordered)}
    again = sk.dense_row_id(df.repartition(2, "a"), ["b", "a"], "n")
    assert {r[2]: r.n for r in again.collect()} == got and again.columns == ["a", "b", "t.x", "n"]
    assert sk.dense_row_id(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError, match="repeat"):
        sk.dense_row_id(df, ["b"])


def test_compressed_indexes(spark, monkeypatch):
    from solekey.operators import bitmaps

    monkeypatch.setattr(bitmaps, "DENSE", 200)
    rng = random.Random(13)
    ids = rng.sample(range(-40_000, 120_000), 4000)
    rows = [(i, rng.choice("aab"), rng.randrange(4), rng.randrange(900)) for i in ids]
    df = spark.createDataFrame(rows, "id long, p string, q int, r int")
    plis = sk.single_column_pli(df, "id")
    index = {c: sk.column_index(plis, c) for c in "pqr"}
    packed = {c: sk.compress_index(i).persist() for c, i in index.items()}
    for c, i in index.items():
        assert rows_of(sk.expand_index(packed[c])) == rows_of(i)
    kinds = packed["q"].agg(F.count("bits"), F.count("positions")).first()
    assert kinds[0] and kinds[1]
    for cols in ("pq", "pr", "pqr"):
        met = packed[cols[0]]
        for c in cols[1:]:
            met = sk.intersect_compressed(met, packed[c])
        plain = sk.intersect_pli(*[index[c] for c in cols])
        assert rows_of(sk.expand_index(met)) == rows_of(plain)
        sizes = plain.groupBy("cluster_id").count()
        assert rows_of(sk.cluster_sizes(met)) == rows_of(sizes)
    assert packed["p"].count() * 4 < index["p"].count()  # containers in the shuffle instead of rows
    empty = sk.compress_index(index["p"].limit(0))
    assert sk.intersect_compressed(empty, packed["q"]).isEmpty() and sk.expand_index(empty).isEmpty()


def test_index_is_read_not_made_again(spark, tmp_path):
    spark.range(200).selectExpr("id", "id % 7 AS a", "id % 11 AS b", "id % 3 AS c").write.parquet(str(tmp_path / "t"))
    plis = sk.single_column_pli(spark.read.parquet(str(tmp_path / "t")), "id")
    met = sk.intersect_pli(*[sk.column_index(plis, c) for c in "abc"])
    assert "FileScan" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.isEmpty()


def test_undescribe_takes_names_as_they_are(spark):
    names = ["a,b", "c", "d`e"]
    level = spark.createDataFrame([([0, 2],), ([1, 2],)], "cols array<int>")
    back = sk.undescribe(sk.describe(level, names), names).select("cols")
    assert sorted(r.cols for r in back.collect()) == [[0, 2], [1, 2]]
    with pytest.raises(Exception, match="no such column"):
        sk.undescribe(spark.createDataFrame([("c,x",)], "ucc string"), names).collect()


def test_names_with_a_backtick(spark):
    df = spark.createDataFrame([(1, 2, "x"), (2, 2, "x"), (3, 1, "y")], "`a``b` int, c int, `d.e` string")
    assert {r.ucc for r in sk.minimal_uccs(df).collect()} == {"a`b"}
    assert sk.exact_median(df, "a`b").first().value == 2


def test_trie_of_many_columns(spark):
    """Three hundred columns; most sets begin with the same one, which must not join them to one another."""
    rng = random.Random(14)
    draw = lambda n: sorted({0, *rng.sample(range(1, 300), n - 1)} if rng.random() < 0.8 else set(rng.sample(range(300), n)))
    known = [draw(rng.randint(1, 4)) for _ in range(300)] + [[5, 9]]
    known = [k for k in known if k != [0]]
    asked = [draw(rng.randint(2, 12)) for _ in range(400)] + [sorted({*rng.choice(known), *draw(5)}) for _ in range(100)]
    asked = [list(c) for c in {tuple(a) for a in asked}]
    left = sk.prune_supersets(sk.combination_frame(spark, asked), sk.combination_frame(spark, known))
    assert sorted(r.cols for r in left.collect()) == sorted(c for c in asked if not any(set(k) <= set(c) for k in known))
    trie = lattice.set_trie(sk.combination_frame(spark, known))
    assert trie.groupBy("node", "column").count().where("count > 1").isEmpty()
    nothing = sk.combination_frame(spark, [])
    assert sk.prune_supersets(sk.combination_frame(spark, asked), nothing).count() == len(asked)


def test_pairs_of_many_columns(spark):
    pairs = sk.level_pairs(spark.createDataFrame([(c,) for c in range(150)], "col int"))
    assert pairs.count() == 150 * 149 // 2 == pairs.distinct().count()


def test_supersets_of_longer_combinations_go(spark):
    every = spark.createDataFrame([([0, 1, 2],), ([0, 1, 3],), ([1, 2, 3],), ([0, 2, 3],)], "cols array<int>")
    known = spark.createDataFrame([([0, 1],), ([1, 2, 3],)], "cols array<int>")
    assert [r.cols for r in sk.prune_supersets(every, known).collect()] == [[0, 2, 3]]
