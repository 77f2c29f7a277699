"""URL filters: longest matching rule by a sort-merge range join.

A rule is a host with a path; it fits a url of that host, or of a subdomain, if
the url's path starts with the rule's. Hosts are reversed by their labels
(www.example.org: org.example.www), so that a host's ancestors are the prefixes
of its labels. A url has one key for each ancestor that has rules: reversed
ancestor, '/', path. Hosts hold no '/', so the keys that a rule fits are exactly
those that begin with the rule's own key: one interval of the sorted keys.

Keys and rules are dealt to parts by range and sorted; a rule goes to every part
that its interval meets. A sweep over a part keeps the stack of rules whose
intervals are open: they are nested, and the top one is the longest. No more is
held than the rules that one key begins with. Boundaries of parts come from a
sample of keys and decide nothing but balance; a key that fills several parts is
dealt over them by row.

Of all rules that fit, the longest host and path together wins, then the longer
host; of equal rules with both verdicts, block.

Defined results: a null url, or one without '://', has empty host and path; a
url that no rule fits has a null rule and the default verdict; repeated rows are
judged one by one; an empty table gives an empty table, and so do rules whose
host is null: they fit nothing. Ports and user names are part of the host, as
given. Of the other columns, those named in carry stay; host, path, rule and
verdict give way to the results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, cut, finished, small, small_batches

#: The rules of the query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
#: Keys sampled for each part.
SAMPLED = 20
LAST = chr(0x10FFFF)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    part = lambda i: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i)
    return ascii_lower(part(1)), part(2)


def ancestors(host: Column) -> Column:
    """The host and the hosts above it, their labels reversed."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _sweep(batches):
    """Rows (_p, key, kind, row, rule), sorted by the first three, rules (kind 0) before urls: the open rule of greatest length for each url."""
    stack: list[tuple[str, dict]] = []
    part = None
    for batch in batches:
        rows, found = [], []
        for p, key, kind, row, rule in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if p != part:
                part = p
                stack.clear()
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule))
            elif stack:
                rows.append(row)
                found.append(stack[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, batch.schema.field(4).type)], ["row", "rule"])


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", carry: tuple[str, ...] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """carry, host, path, rule and verdict of each url; rules have host, path and verdict."""
    return finished(lambda: _judged(urls, rules, url, carry, default))


def _judged(urls: DataFrame, rules: DataFrame, url: str, carry: tuple[str, ...], default: str) -> DataFrame:
    spark = urls.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col(f"`{url}`"))
    keep = [c for c in carry if c not in ("host", "path", "rule", "verdict")]
    keyed = cut(urls.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_carry"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")))

    named = rules.filter(F.col("host").isNotNull()).groupBy(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    named = cut(named.select(_reversed(F.col("host")).alias("at"), F.concat(_reversed(F.col("host")), F.lit("/"), "path").alias("key"), rule.alias("rule")))
    hosts = named.select("at").distinct()

    levels = keyed.select("row", "path", F.explode(ancestors(F.col("host"))).alias("at"))
    keys = cut(levels.join(small(hosts, hosts.count()), "at", "left_semi").select("row", F.concat("at", F.lit("/"), "path").alias("key")))
    sample = np.array(sorted(r.key for r in keys.orderBy(F.xxhash64("row")).limit(SAMPLED * n).select("key").collect()), dtype=object)
    bounds = sample[np.linspace(0, len(sample), n + 1)[1:-1].astype(int)] if len(sample) else sample

    @F.pandas_udf("int")
    def part(key: pd.Series, row: pd.Series) -> pd.Series:
        low, high = np.searchsorted(bounds, key.to_numpy(object), "left"), np.searchsorted(bounds, key.to_numpy(object), "right")
        return pd.Series(low + row.to_numpy() % (high - low + 1))

    @F.pandas_udf("array<int>")
    def parts(key: pd.Series) -> pd.Series:
        low, high = np.searchsorted(bounds, key.to_numpy(object), "left"), np.searchsorted(bounds, (key + LAST).to_numpy(object), "right")
        return pd.Series([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])

    none = F.lit(None).cast(named.schema["rule"].dataType)
    events = keys.select(part("key", F.abs(F.xxhash64("row")) % (1 << 30)).alias("_p"), "key", F.lit(1).alias("kind"), "row", none.alias("rule")).unionByName(
        named.select(F.explode(parts("key")).alias("_p"), "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), "rule")
    )
    swept = events.repartition(n, "_p").sortWithinPartitions("_p", "key", "kind").mapInArrow(_sweep, f"row long, rule {named.schema['rule'].dataType.simpleString()}")
    best = swept.groupBy("row").agg(F.max("rule").alias("rule"))
    return keyed.join(best, "row", "left").select(*[F.col("_carry")[c].alias(c) for c in keep], "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(list(RULES), "host string, path string, verdict string"))
