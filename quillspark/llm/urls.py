"""URL filters by a sort-merge range join.

A host turns into its reversed labels with a closing dot (``blog.example.org`` is ``org.example.blog.``), so a rule for a
host and its subdomains is one interval of keys. URLs and rules are dealt by ranges of (key, salt): a rule goes to each
range that its interval meets, a hot host is spread over ranges by its salt. In each range one sorted sweep keeps a stack
of the rules whose intervals are open.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_partitions

#: Rows that are sampled to place each border between ranges; a wrong guess costs balance, never results.
SAMPLE_A_RANGE = 64
RANGES_A_PARTITION = 4
DEALT = "range_no int, key string, kind int, id long, host string, path string, verdict string"


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def with_host_and_path(df: DataFrame, url: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for a null or a url without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    return df.withColumn("_rest", rest).select(
        *df.columns,
        ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def _salt(row_id: int | None) -> int:
    return zlib.crc32(b"%d" % (-1 if row_id is None else row_id))


def _deal(borders: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hosts, paths, verdicts = (c.to_pylist() for c in b.columns)
            out: list[list] = [[] for _ in range(7)]
            for i, host, path, verdict in zip(ids, hosts, paths, verdicts):
                key = key_of(host)
                if verdict is None:
                    first = last = bisect_right(borders, (key, _salt(i)))
                else:  # a rule is copied to all ranges from its own key to the last key under it
                    first, last = bisect_right(borders, (key, -1)), bisect_right(borders, (key[:-1] + "/", -1))
                for r in range(first, last + 1):
                    for column, x in zip(out, (r, key, int(verdict is None), i, host, path, verdict)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["range_no", "key", "kind", "id", "host", "path", "verdict"])

    return run


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, known, fitting = None, [], None, []
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for r, key, kind, i, host, path, verdict in zip(*(c.to_pylist() for c in b.columns)):
                if r != at:
                    at, stack, known = r, [], None
                if key != known or kind == 0:
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    known = None
                if kind == 0:
                    stack.append((key, host, path, verdict))
                    continue
                if known is None:  # the rules open here, the longest first, then the one with the longer host
                    known = key
                    fitting = sorted(((h + p, p, v) for _, h, p, v in stack), key=lambda x: (-len(x[0]), len(x[1])))
                rule, verdict = next(((s, v) for s, p, v in fitting if path.startswith(p)), (None, default))
                for column, x in zip(out, (i, host, path, rule, verdict)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), *[pa.string()] * 4))], ["id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(df: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rule and verdict of each url: (id_col, host, path, rule, verdict), a row for each row of df.

    rules: (host, path, verdict) rows. A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule (host + path) wins, of equal ones that with the longer host. Where none fits, rule is null and the verdict
    is default. A null url, and one without ``://``, has an empty host and path. Repeated rows and null ids give a row
    each; other columns, whatever they are called, are left out. An empty table gives no rows.
    """
    spark = df.sparkSession
    urls = with_host_and_path(df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")), "url").select("id", "host", "path")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    parts = shuffle_partitions(spark)
    ranges = parts * RANGES_A_PARTITION
    rows = urls.count()
    some = urls.sample(min(1.0, SAMPLE_A_RANGE * ranges / max(rows, 1)), seed=7).select("id", "host").collect() if rows else []
    keys = sorted((key_of(x.host), _salt(x.id)) for x in some)
    borders = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    all_rows = urls.withColumn("verdict", F.lit(None).cast("string")).unionByName(rules.select(F.lit(None).cast("long").alias("id"), ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct())
    dealt = all_rows.mapInArrow(_deal(borders), DEALT)
    swept = dealt.repartition(parts, "range_no").sortWithinPartitions("range_no", "key", "kind").mapInArrow(_sweep(default), "id long, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)
