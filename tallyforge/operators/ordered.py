"""Ordered state within a file: line numbers, cumulative counters and carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent_decoded
from ..staging import staged


def with_line_ordinals(df: DataFrame) -> DataFrame:
    """Adds line_ord, which grows from line to line of a file across its splits, and part, where the split begins. df is spark.read.text with its _metadata.

    Nothing moves: a split's place in the file and a line's place in its task are known where the line is read. A task reads at most
    as many bytes, and so lines, as a split has, so twice the start of the split plus the place in the task is in the order of the file.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    start = F.col("_metadata.file_block_start")
    return df.select("value", percent_decoded(F.col("_metadata.file_path")).alias("file_path"), (2 * start + place).alias("line_ord"), start.alias("part"))


def placed(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds place (from 1) in a total order and before_<name>, the sum of each of sums over all rows before.

    The order is cut into ranges that are sorted side by side; only a row for each range meets in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = df.select("*", *[c.alias(f"__{n}") for n, c in sums.items()])
    cut = staged(given.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "placed")
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = cut.groupBy("__part").agg(F.count("*").alias("__rows"), *[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    ranges = ranges.select(F.col("__part").alias("__range"), *[upto(f"__{n}", ahead).alias(f"__ahead_{n}") for n in ("rows", *sums)])
    rows = cut.withColumn("__rows", F.lit(1)).select("*", *[upto(f"__{n}", here).alias(f"__here_{n}") for n in ("rows", *sums)])
    joined = rows.join(F.broadcast(ranges), F.col("__part") == F.col("__range"))  # at most a row for each partition
    both = lambda n: F.col(f"__ahead_{n}") + F.col(f"__here_{n}")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (both("rows") + 1).alias("place"), *[both(n).alias(f"before_{n}") for n in sums])


#: Rows that are put in order by one task; more are cut into ranges.
FEW = 10_000


def numbered(df: DataFrame, order: list[Column], few: bool = False) -> DataFrame:
    """Adds place (from 1) in a total order. few says that there are at most FEW rows, which one task sorts without a staged copy."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")) if few else placed(df, order)


def so_far(keys: list[str], order: list[str]):
    """Window from the first row of the keys to the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last value so far that is not null."""
    return F.last(value, ignorenulls=True).over(so_far(keys, order))


def carried_across(rows: DataFrame, values: dict[str, tuple[Column, int]], file: str, order: str, part: str | None = None) -> DataFrame:
    """Adds for each name the last value that is not null so far in its file: up to this row (0) or the one before it (-1).

    With part, a file is worked on in its parts side by side: each carries its own values, its last ones are a row of a small table, a running
    last over the parts of a file says what each part inherits, and rows before the first value of a part take that. rows is read
    twice then, so it should be staged. Without part, a file is one window.
    """
    keys = [file] if part is None else [file, part]
    here = lambda to: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, to)
    local = {n: F.last(v, ignorenulls=True).over(here(to)) for n, (v, to) in values.items()}
    if part is None:
        return rows.withColumns(local)
    ends = rows.select(file, part, order, *[v.alias(n) for n, (v, _) in values.items()])
    ends = ends.groupBy(file, part).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in values])
    ahead = Window.partitionBy(file).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a file
    given = ends.select(file, part, *[F.last(n, ignorenulls=True).over(ahead).alias(f"__given_{n}") for n in values])
    out = rows.withColumns({f"__own_{n}": c for n, c in local.items()}).join(given, [file, part], "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in values]
    return out.select(*kept, *[F.coalesce(f"__own_{n}", f"__given_{n}").alias(n) for n in values])


def cumulative_delta(df: DataFrame, keys: list[str], order: list[str], totals: list[str], given: str | None = None) -> DataFrame:
    """Adds delta_<total> for running totals and drops rows that repeat the totals before them or add nothing.

    given names a column with a struct of the same fields: where it is not null it is the delta as a whole. A total that
    falls counts as no growth. Null totals count as 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    vector = F.struct(*[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in totals])
    rows = df.withColumn("__now", vector).withColumn("__before", F.lag("__now").over(w))
    rows = rows.where(~F.col("__now").eqNullSafe(F.col("__before")))
    for t in totals:
        grown = F.greatest(F.col(f"__now.{t}") - F.coalesce(F.col(f"__before.{t}"), F.lit(0)), F.lit(0))
        if given is not None:
            grown = F.when(F.col(given).isNotNull(), F.coalesce(F.col(f"{given}.{t}"), F.lit(0)).cast("long")).otherwise(grown)
        rows = rows.withColumn(f"delta_{t}", grown)
    some = F.lit(False)
    for t in totals:
        some = some | (F.col(f"delta_{t}") != 0)
    return rows.where(some).drop("__now", "__before")


def residual(rows: DataFrame, keys: list[str], parts: str, totals: list[str], fallback: str = "model") -> DataFrame:
    """Usage by model of records with a total and a map of parts: a row for each part, and one for what the parts leave.

    parts names a map column from model to a struct with the fields of totals; the total fields are columns of rows, and
    fallback is the column with the model that gets the rest. Rests are never negative; rows without usage are left out.
    """
    none = F.lit(0).cast("long")
    given = F.coalesce(F.map_entries(parts), F.array().cast(rows.select(F.map_entries(parts)).schema[0].dataType))
    value = lambda v, t: F.coalesce(v[t], none).cast("long")
    each = F.transform(given, lambda e: F.struct(e["key"].alias(fallback), *[value(e["value"], t).alias(t) for t in totals]))
    summed = lambda t: F.aggregate(given, none, lambda a, e: a + value(e["value"], t))
    rest = F.struct(F.col(fallback), *[F.greatest(F.col(t) - summed(t), none).alias(t) for t in totals])
    every = rows.select(*keys, F.explode(F.concat(each, F.array(rest))).alias("__x")).select(*keys, "__x.*")  # rows are read once
    out = every.groupBy(*keys, fallback).agg(*[F.sum(t).alias(t) for t in totals])
    used = F.lit(False)
    for t in totals:
        used = used | (F.col(t) > 0)
    return out.where(used)


def snapshot_tokens(groups: DataFrame, key: str, group: str, tokens: str, *flags: str) -> DataFrame:
    """Tokens of sessions known by growing snapshots: the sum over groups of their largest, else the session's largest. flags hold for a session if for any of its rows."""
    any_of = [F.max(f).alias(f) for f in flags]
    by_group = groups.groupBy(key, group).agg(F.max(tokens).alias("__t"), *any_of)  # rows are read once
    known = F.sum(F.when(F.col(group).isNotNull(), F.col("__t")))
    return by_group.groupBy(key).agg(F.coalesce(known, F.max("__t")).alias(tokens), *any_of)
