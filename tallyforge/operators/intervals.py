"""Many date ranges over one pass: the axis is cut at all ends of ranges, and ranges are put together from the segments between.

A fact lies in one segment, found by binary search in the cuts. The best candidate of each id is taken for each segment that the id
occurs in, mostly one. Among an id's candidates, one that lies in segment s counts for just those ranges from segment a to b
with left < a <= s <= b < right, where left and right are the nearest segments with a better candidate. So sums by
(left, s, right, model) say all there is to know about any range, and only these small sums meet the ranges.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import resums, sums, with_cost_parts
from . import dedup

MOST = 10_000


class Cuts:
    """Named date ranges, inclusive, each side possibly open. A row without a date is in a range only if both of its sides are open."""

    def __init__(self, wanted: list[tuple[str, date | None, date | None]]):
        if len(wanted) > MOST:
            raise ValueError(f"more than {MOST} ranges")
        self.wanted = wanted
        later = {u + timedelta(days=1) for _, _, u in wanted if u is not None and u < date.max}
        self.starts = sorted({s for _, s, _ in wanted if s is not None} | later)  # segment i + 1 starts at starts[i]; 0 has no date
        self.last = len(self.starts) + 1
        place = {d: i + 2 for i, d in enumerate(self.starts)}
        self.spans = []
        for n, (name, since, until) in enumerate(wanted):
            first = place[since] if since is not None else (0 if until is None else 1)
            end = self.last if until is None or until == date.max else place[until + timedelta(days=1)] - 1
            self.spans.append((n, name, first, end))

    def table(self, spark: SparkSession) -> DataFrame:
        """position, range_id, and the first and last segment."""
        return spark.createDataFrame(self.spans, "position int, range_id string, first int, last int")

    def segment(self, day: Column) -> Column:
        """The segment of a date: 0 without a date, 1 before the first cut."""
        if not self.starts:
            return F.when(day.isNull(), 0).otherwise(1)
        if len(self.starts) <= 16:
            out = F.lit(1)
            for s in self.starts:
                out = out + (day >= F.lit(s)).cast("int")
            return F.when(day.isNull(), 0).otherwise(out)
        starts = F.array(*map(F.lit, self.starts))
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.starts).bit_length()))])
        further = lambda n, k: (n + k <= len(self.starts)) & (F.try_element_at(starts, n + k) <= day)
        return F.when(day.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.coalesce(further(n, k), F.lit(False)), n + k).otherwise(n)) + 1)

    def sums(self, rows: DataFrame, columns: tuple[str, ...], deduplicated: bool = True) -> DataFrame:
        """Sums by (left, segment, right, model, rejected), with rows (all facts of the ids that won in their segment) and errors.

        rows: facts with columns, date and rejected.
        """
        rows = rows.withColumn("segment", F.when(F.col("rejected"), 0).otherwise(self.segment(F.col("date"))))
        keep = dict.fromkeys((*dedup.IDENTITY, *columns, "segment", "rejected"))
        if not deduplicated:
            told = rows.select(*keep, F.lit(1).cast("long").alias("entries"), F.lit(-1).alias("left"), F.lit(self.last + 1).alias("right"))
        else:
            best = dedup.counted(rows.select(*keep), ("segment",)).withColumn("segment", F.coalesce("segment", F.lit(0)))
            told = self._reaching(best)
        told = told.withColumn("ids", F.when(F.col("message_id").isNotNull() & ~F.col("rejected"), F.col("entries")).otherwise(0) if deduplicated else F.lit(0).cast("long"))
        parts = with_cost_parts(told)
        return parts.groupBy("left", "segment", "right", "model", "rejected").agg(
            *sums(), F.sum("ids").alias("id_rows"), F.count_if(F.col("ids") > 0).alias("ids"), F.coalesce(F.sum(F.when(F.col("rejected"), F.col("entries"))), F.lit(0)).alias("errors"),
        )

    def _reaching(self, best: DataFrame) -> DataFrame:
        """Adds left and right. best: one row for each id and segment. An id has at most as many as there are segments."""
        none = F.col("message_id").isNull() | F.col("rejected")
        scope = F.when(none, F.lit(None)).otherwise(dedup.scope())
        alone = F.when(none, F.monotonically_increasing_id())
        stamp = F.col("timestamp_ms")
        order = F.struct(F.col("stop_reason").isNull().alias("open"), stamp.isNull().alias("never"), (-stamp).alias("late"), "file_path", "line_ord")
        if self.last == 1:
            return best.select("*", F.lit(-1).alias("left"), F.lit(self.last + 1).alias("right"))
        item = F.struct(F.col("segment").alias("s"), order.alias("o"), F.struct("*").alias("row"))
        groups = best.select(scope.alias("__scope"), F.col("message_id").alias("__id"), alone.alias("__alone"), item.alias("i")).groupBy("__scope", "__id", "__alone").agg(F.collect_list("i").alias("all"))
        def reach(x):
            better = F.filter("all", lambda y: y["o"] < x["o"])
            below = F.array_max(F.transform(F.filter(better, lambda y: y["s"] < x["s"]), lambda y: y["s"]))
            above = F.array_min(F.transform(F.filter(better, lambda y: y["s"] > x["s"]), lambda y: y["s"]))
            return F.struct(x["row"].alias("row"), F.coalesce(below, F.lit(-1)).alias("left"), F.coalesce(above, F.lit(self.last + 1)).alias("right"))

        each = groups.select(F.explode(F.transform("all", reach)).alias("e"))
        return each.select("e.row.*", "e.left", "e.right")

    def merged(self, sums_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sums by position, range_id and model; quality by position and range_id). sums_: a few rows, staged."""
        ranges = self.table(sums_.sparkSession)
        spans = ranges.select("position", "range_id", "first", "last", F.explode(F.sequence("first", "last")).alias("segment"))
        inside = sums_.join(spans, "segment")
        wins = (F.col("left") < F.col("first")) & (F.col("last") < F.col("right"))
        told = inside.where(wins).groupBy("position", "range_id", "model").agg(*resums())
        counts = inside.groupBy("position", "range_id").agg(
            F.sum(F.when(wins, F.col("entries"))).alias("valid"), (F.sum("id_rows") - F.coalesce(F.sum(F.when(wins, F.col("ids"))), F.lit(0))).alias("dedup_skipped")
        )
        some = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("valid", "dedup_skipped")]
        return told, ranges.select("position", "range_id").join(counts, ["position", "range_id"], "left").select("position", "range_id", *some)
