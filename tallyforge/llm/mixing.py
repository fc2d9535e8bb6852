"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Every document has a fixed uniform number u; the blocks of a source are ranges of u, so their order is a permutation of
the source. A source takes whole copies of itself (epochs) and, for the rest of its target, its first blocks in that
order; the last of them is cut between documents where the target is met. The number of blocks that each source gives is
then its quota. A binary tree splits the quotas over the output shards: at each node the left half gets its exact share of
blocks, composed by a multivariate hypergeometric draw, as if all blocks had been shuffled globally. Which of a source's
blocks a shard gets is a random order too, so shards draw disjoint permuted blocks; inside a shard rows are sorted by another hash.

Defined cases: a null text has size 0; a null source is a source, the last one; a null or repeated doc_id is allowed (rows
with equal ids are taken together); sources without words get target 0; an empty table gives an empty mix; extra columns
pass through. Sources may be many: ranks, targets and quotas are tables, and the driver holds the quotas of at most GROUPS groups.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import placed
from .common import WORD, lookup, partitions, staged, unit_hash

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
BLOCK_DOCS, MAX_BLOCKS = 512, 1024
SHARDS = 16
GROUPS = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, rank, target): shares by weight, capped, the excess reshared by weight (water filling)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = placed(sums, [F.col("source").asc_nulls_last()]).withColumnRenamed("place", "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEAT)
    filled = placed(weighed, [F.col("cap") / F.col("weight"), F.col("rank")], cap=F.col("cap"), weight=F.col("weight")).drop("place")
    filled = staged(filled, "mix-filled")
    size, weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit((size or 0) * TOTAL_SHARE) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight"))
    # The first source, by cap per weight, that its level does not fill sets the level of all that follow.
    met = F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), level.alias("level")))
    level = filled.agg(F.min(met)["level"]).first()[0]
    return filled.select("source", "source_size", "n_docs", "rank", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def block_of(u: Column, blocks: Column) -> Column:
    """The block of a 52-bit uniform number."""
    return F.shiftright(u * blocks, 52)


def quotas(sized: DataFrame) -> DataFrame:
    """Per source: target, whole copies, and where the partial copy ends (edge_block, cut, pick). sized has source, size, u.

    The edge block is cut a second time, so the rows of a source that are put in order are its last MAX_BLOCKS-th of a MAX_BLOCKS-th.
    """
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK_DOCS))).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sized = staged(sized, "mix-sizes")
    plan = targets(sized).withColumn("blocks", blocks).withColumn("copies", whole)
    plan = staged(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    with_block = of_sources(sized, plan, plan).withColumn("block", block_of(F.col("u"), F.col("blocks")))
    edges = edge(with_block.groupBy("source", "rest", "block").agg(F.sum("size").alias("words")), "block", "rest")
    edges = staged(edges.select(F.col("source").alias("s"), F.col("block").alias("edge_block"), "need"), "mix-edges")
    inside = with_block.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("edge_block")))
    inside = inside.groupBy("source", "need", "u", "blocks").agg(F.sum("size").alias("size"))  # rows of equal ids go together
    part = block_of((F.col("u") * F.col("blocks")).bitwiseAND((1 << 52) - 1), F.lit(MAX_BLOCKS).cast("long"))
    inside = staged(inside.select("source", "need", "u", "size", part.alias("part")), "mix-inside")
    last = edge(inside.groupBy("source", "need", "part").agg(F.sum("size").alias("words")), "part", "need").withColumnsRenamed({"source": "s", "need": "room", "part": "edge_part"})
    run = inside.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("edge_part")))
    run = run.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("u")))
    fits = F.col("upto") <= F.col("room")
    cuts = run.groupBy(F.col("source").alias("s")).agg(
        F.coalesce(F.max(F.when(fits, F.col("u"))), F.min("u") - 1).alias("cut"),
        (F.max("room") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("left"),
    )
    cuts = staged(cuts, "mix-cuts")
    over = inside.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("u") > F.col("cut")))
    miss = F.abs(F.col("size") - F.col("left"))
    picks = over.where(miss < F.col("left")).groupBy(F.col("source").alias("p")).agg(F.min(F.struct(miss.alias("miss"), F.col("u").alias("u")))["u"].alias("pick"))
    found = edges.alias("e").join(cuts.alias("c"), F.col("e.s").eqNullSafe(F.col("c.s")), "left").join(picks, F.col("e.s").eqNullSafe(F.col("p")), "left")
    found = found.select(F.col("e.s").alias("s"), "edge_block", "cut", "pick")
    return staged(plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-quotas")


def of_sources(rows: DataFrame, found: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with what found has of their source (null is one). A source may hold any part of the rows: plan says how many each has (n_docs)."""
    key = F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).alias("__source")
    counts = plan.select(key, F.col("n_docs").alias("count"))
    return lookup(rows.select("*", key), found.select(key, *[c for c in found.columns if c != "source"]), "__source", counts, whole=True).drop("__source")


def edge(sums: DataFrame, part: str, room: str) -> DataFrame:
    """(source, part, need): the first part of a source that its room does not hold whole, and what is left for it. sums: at most MAX_BLOCKS rows a source."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(part))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col(room))
    first = F.min_by(F.struct(F.col(part), (F.col(room) - F.col("upto") + F.col("words")).alias("need")), part)
    return over.groupBy("source").agg(first.alias("e")).select("source", f"e.{part}", "e.need")


def drawn(c: Column) -> Column:
    """Whether the partial copy takes a row with block and u."""
    inside = (F.col("block") < c["edge_block"]) | ((F.col("block") == c["edge_block"]) & (F.col("u") <= c["cut"]))
    return F.coalesce(inside | (F.col("u") == c["pick"]), F.lit(False))


def split_quotas(quota: np.ndarray, shards: int, seed: int = 1) -> np.ndarray:
    """int[source, shard]: exact quotas dealt over shards by a binary tree of multivariate hypergeometric draws."""
    out = np.zeros((len(quota), shards), np.int64)
    nodes = [(0, shards, quota.astype(np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[:, low] = have
            continue
        middle = (low + high) // 2
        n = int(have.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)
        nodes += [(low, middle, left), (middle, high, have - left)]
    return out


def block_shards(plan: DataFrame, shards: int) -> DataFrame:
    """(s, shards) for each source: the shard of each of its blocks, at most (MAX_REPEAT + 1) * MAX_BLOCKS.

    The tree deals the quotas of GROUPS groups of sources (one source a group while there are no more): that is all that the
    driver holds. Inside a group all blocks are put in random order, and the shards take their exact numbers from it one after
    the other, which is the same multivariate hypergeometric draw. plan has source, rank and quota.
    """
    grouped = plan.select("source", "rank", "quota", F.pmod("rank", F.lit(GROUPS)).cast("int").alias("g"))
    have = {x["g"]: x["n"] for x in grouped.groupBy("g").agg(F.sum("quota").alias("n")).collect()}  # at most GROUPS rows
    known = sorted(have)
    ends = split_quotas(np.array([have[g] for g in known], np.int64), shards).cumsum(axis=1) if known else []
    split = F.from_json(F.lit(json.dumps([{"h": g, "upto": e.tolist()} for g, e in zip(known, ends)])), "array<struct<h:int,upto:array<bigint>>>")
    split = plan.sparkSession.range(1).select(F.inline(split))
    blocks = grouped.where("quota > 0").select("source", "rank", "g", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("i"))
    order = Window.partitionBy("g").orderBy(unit_hash(f"{SEED}-tree", F.col("rank"), F.col("i")), "rank", "i")
    taken = blocks.withColumn("at", F.row_number().over(order)).join(F.broadcast(split), F.col("g") == F.col("h"))
    shard = F.size(F.filter("upto", lambda e: e < F.col("at"))).alias("shard")
    told = taken.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("i", shard))).alias("told"))
    return told.select("s", F.transform("told", lambda x: x["shard"]).alias("shards"))


def dealt(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (row, source, size, u) with source_size, target and draws, an array of (epoch, shard), one for each copy that is taken."""
    plan = quotas(rows.select("source", "size", "u"))
    quota = F.col("copies") * F.col("blocks") + F.coalesce(F.col("edge_block") + 1, F.lit(0))
    each = staged(block_shards(plan.select("source", "rank", quota.alias("quota")), shards), "mix-shards")
    plan = staged(plan.join(each, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rank", "rest"), "mix-plan")
    found = of_sources(rows, plan.drop("n_docs"), plan).withColumn("block", block_of(F.col("u"), F.col("blocks")))
    part = drawn({x: F.col(x) for x in ("edge_block", "cut", "pick")})

    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies")), lambda epoch: F.struct(epoch.alias("epoch"), F.get("shards", epoch * F.col("blocks") + F.col("block")).alias("shard")))
    draws = F.filter(draws, lambda d: d["shard"].isNotNull() & ((d["epoch"] < F.col("copies")) | part))
    return found.select("row", "size", "source_size", "target", "u", draws.alias("draws"))


def mix(docs: DataFrame, text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The mix itself: (row struct, epoch, shard, position), one row for each copy of a document that is taken."""
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    rows = docs.select(row, F.col("source"), word_count(F.col(f"`{text_col}`")).alias("size"), unit_hash(SEED, F.col("doc_id")).alias("u"))
    out = dealt(rows, shards).select("row", "u", F.explode("draws").alias("draw")).select("row", "draw.epoch", "draw.shard", "u")
    return out.select("row", "epoch", "shard", unit_hash(f"{SEED}-order", F.col("shard"), F.col("epoch"), F.col("u")).alias("position"))


def mixed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of the mix with the columns of docs, repeats as repeated rows, shuffled inside each shard."""
    rows = mix(docs, text_col)
    bits = max(6, (4 * partitions(docs.sparkSession) // SHARDS).bit_length())  # of the position: each shard is cut into so many ranges
    return rows.repartition(F.col("shard"), F.shiftright(F.col("position"), 52 - bits)).sortWithinPartitions("shard", "position").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with its source's size and target."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.struct("doc_id").alias("row"), "source", word_count(F.col("text")).alias("size"), unit_hash(SEED, F.col("doc_id")).alias("u"))
    out = dealt(staged(rows, "mix-rows"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS u
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY 2 * source_size / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), met AS (
  SELECT level FROM levels WHERE level * weight <= 2 * source_size ORDER BY 2 * source_size / weight::DOUBLE, rank LIMIT 1
), targets AS (
  SELECT source, source_size, n_docs, least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM met) * weight) AS target FROM levels
), plan AS (
  SELECT *, CAST(least(1024, greatest(1, ceil(n_docs / 512))) AS BIGINT) AS blocks,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets
), docs AS (
  SELECT d.*, source_size, target, blocks, copies, target - copies * source_size AS rest, (u * blocks) >> 52 AS block
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), edges AS (
  SELECT source, block, rest - upto + words AS need FROM (
    SELECT source, block, rest, words, sum(words) OVER (PARTITION BY source ORDER BY block) AS upto FROM (
      SELECT source, block, rest, sum(size) AS words FROM docs GROUP BY ALL))
  WHERE upto > rest QUALIFY row_number() OVER (PARTITION BY source ORDER BY block) = 1
), inside AS (
  SELECT source, need, u, size, sum(size) OVER (PARTITION BY source ORDER BY u) AS upto FROM (
    SELECT d.source, e.need, d.u, sum(d.size) AS size FROM docs d
    JOIN edges e ON d.source IS NOT DISTINCT FROM e.source AND d.block = e.block GROUP BY ALL)
), room AS (
  SELECT *, need - coalesce(max(upto) FILTER (upto <= need) OVER (PARTITION BY source), 0) AS room FROM inside
), cuts AS (
  SELECT source, coalesce(max(u) FILTER (upto <= need), -1) AS cut,
         arg_min(u, (abs(size - room), u)) FILTER (upto > need AND abs(size - room) < room) AS pick FROM room GROUP BY source
)
SELECT d.doc_id, d.size, d.source_size, d.target,
       d.size * (d.copies + CASE WHEN coalesce(d.block < e.block OR (d.block = e.block AND d.u <= c.cut), false) OR coalesce(d.u = c.pick, false) THEN 1 ELSE 0 END) AS taken
FROM docs d LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""
