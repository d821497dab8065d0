"""URL rules by a sort-merge range join over reversed-host keys; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solekey.session import durable

DEFAULT_VERDICT = "allow"

# Stands between host and path in a key, so that no host is the beginning of a longer label.
END = "\x00"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a host part."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The host's last labels, at most so many, and each domain above, longest first; none for an empty host."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    first = F.greatest(n - most_labels + 1, F.lit(1))
    return F.when(
        host != "", F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    ).otherwise(F.array().cast("array<string>"))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """``key, chain``: each rule's canonical key and the rules that enclose it, itself included.

    A key is the reversed host and the path, so a rule covers exactly the keys that begin with
    its own: an interval, and two intervals are nested or apart. Of rules with the same host and
    path the one whose verdict sorts last counts.
    """
    own = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(
            F.concat(reversed_host(F.translate("host", _UPPER, _LOWER)), F.lit(END), F.col("path")).alias("key"),
            F.concat(F.translate("host", _UPPER, _LOWER), F.col("path")).alias("rule"),
            "verdict",
        )
        .groupBy("key", "rule")
        .agg(F.max("verdict").alias("verdict"))
    )
    prefixes = own.select(F.col("key").alias("inner"), F.explode(_prefixes(F.col("key"))).alias("key"))
    return (
        prefixes.join(own, "key")
        .groupBy(F.col("inner").alias("key"))
        .agg(F.collect_list(F.struct("key", "rule", "verdict")).alias("chain"))
    )


def _prefixes(key: Column) -> Column:
    """All beginnings of a rule's key, or of a key cut to the longest rule's length."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.substr(key, F.lit(1), i))


def _extent(known: DataFrame) -> tuple[int, int]:
    """Signs of the longest rule's key and labels of its longest host: no url is looked at beyond them."""
    labels = F.size(F.split(F.substring_index("key", END, 1), "\\."))
    row = known.agg(F.max(F.length("key")), F.max(labels)).first()
    return max(1, row[0] or 0), max(1, row[1] or 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest rule (host and path together, then by key) wins, and
    ``rule`` is its host and path. Urls that fit none get a null rule and the ``default`` verdict.

    A url becomes one key for its host and for each domain above it, so that a rule fits if a key
    lies in the rule's interval. Keys are made only of as many labels as a rule's host has, and cut
    to the length of the longest rule, which changes no beginning that a rule could have. Rules and keys are sorted together into ranges; a key that very
    many urls share is split by a hash of the page. A range starts with the rules that enclose
    its first key. In each range one sorted sweep hands on the chain of the last rule begun:
    the stack of nested rules, of which those already ended are taken off. Rules and urls meet
    only there: nothing is broadcast and no pair outside an interval is made.

    Null urls and such without ``://`` have an empty host and path and fit nothing. Repeated rows
    each give a row. Rules with a null part are left out; without rules, or with an empty table,
    the result follows the same lines. Other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    known = durable(keyed_rules(rules))
    longest, most_labels = _extent(known)
    urls = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(host_suffixes(F.col("host"), most_labels))
    no_chain = F.lit(None).cast(known.schema["chain"].dataType)
    keys = parts.select("page_id", "host", "path", F.posexplode(suffixes).alias("level", "suffix")).select(
        F.substr(F.concat(reversed_host(F.col("suffix")), F.lit(END), F.col("path")), F.lit(1), F.lit(longest)).alias("key"),
        no_chain.alias("chain"),
        F.lit(1).alias("kind"),
        F.xxhash64("page_id", "level").alias("salt"),
        "page_id",
        "host",
        "path",
        "level",
    )
    begins = known.select(
        "key",
        "chain",
        F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("salt"),
        *[F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in ("page_id", "host", "path", "level")],
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = durable(
        keys.unionByName(begins).repartitionByRange(n, "key", "kind", "salt").withColumn("range", F.spark_partition_id())
    )
    first = ranges.groupBy("range").agg(F.min("key").alias("first_key"))
    carried = (
        first.select("range", "first_key", F.explode(_prefixes(F.col("first_key"))).alias("key"))
        .join(known, "key")
        .groupBy("range")
        .agg(F.max_by("chain", F.length("key")).alias("chain"), F.first("first_key").alias("key"))
        .select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("range", "chain", "key", "kind") else
                  (F.lit(-1).alias("kind") if f.name == "kind" else F.col(f.name)) for f in ranges.schema])
    )
    sweep = Window.partitionBy("range").orderBy("key", "kind", "salt").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        ranges.unionByName(carried)
        .withColumn("stack", F.last("chain", ignorenulls=True).over(sweep))
        .where("kind = 1")
        .withColumn("fits", F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"])))
    )
    best = F.array_max(
        F.transform(
            "fits",
            lambda r: F.struct(F.length(r["rule"]).alias("size"), F.replace(r["key"], F.lit(END), F.lit("")).alias("key"), r["rule"].alias("rule"), r["verdict"].alias("verdict")),
        )
    )
    # A url's own key (level 0) stands once for each of its rows, however often the row repeats.
    judged = (
        swept.select("page_id", "host", "path", best.alias("best"), (F.col("level") == 0).cast("long").alias("own"))
        .groupBy("page_id", "host", "path")
        .agg(F.max("best").alias("best"), F.sum("own").alias("times"))
    )
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
