"""URL filter by a character language-model ratio, in DataFrame operations only.

Rules decide what they fit and label the URLs that they fit. Two smoothed variable-order Markov models, one of accepted and
one of rejected URLs, are counted over all of those; the probability of a character blends orders 0 to 4, each order
backing off to the shorter one (p_k = (n(context, char) + m * p_(k-1)) / (n(context) + m)). A URL's score is the mean
log-likelihood difference of its characters. The threshold is calibrated on a fifth of the labelled URLs, which the
models never see: the point that lies equally many standard deviations from either class.

The models see the whole URL, query and fragment included. Work follows distinct text: characters are looked up once for
each distinct five-character window, windows are joined to distinct URLs, URLs to pages. Log ratios are whole millionths, so
sums do not depend on their order.

Defined cases: a null URL is an empty one; a URL without ``://`` has an empty host and path, fits no rule and is judged by its
text; repeated rows are judged alike; without labels of both classes every score is 0 against a threshold of 0, so the verdict is allow; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, partitions, staged

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER, PRIOR, ALPHABET = 4, 4.0, 256.0
HELD_OUT = 5
PAD, STOP = "\x02", "\x03"


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    safe = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower(F.regexp_extract(safe, pattern, 1)), F.regexp_extract(safe, pattern, 2)


def fitting(rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits columns host and path, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def windows(text: Column) -> Column:
    """All windows of ORDER + 1 characters, each ending at another character of the text or at its end."""
    chars = F.split(F.concat(F.lit(PAD * ORDER), text, F.lit(STOP)), "")
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(ORDER + 1)), ""))


def window_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(window, ratio): millionths of ln p(accepted) - ln p(rejected) for wanted windows. counts: window, a, r.

    One order after the other: a gram of k + 1 characters looks up the gram without its first character, whose blend is known
    from the order before, and the context without its last one. Distinct grams that share either are at most as many
    as there are characters, so no key of these joins grows with the data, however common it is in URLs.
    """
    sums = [F.sum("a").alias("a"), F.sum("r").alias("r")]
    total = counts.agg(*sums).first()  # what all windows share: the empty context
    before = None
    for k in range(ORDER + 1):
        gram = F.expr(f"right(window, {k + 1})").alias("gram")
        grams = counts.groupBy(gram).agg(*sums)
        asked = wanted.select(gram).distinct() if k < ORDER else wanted.select(gram)
        rows = asked.join(grams.select("gram", F.col("a").alias("ga"), F.col("r").alias("gr")), "gram", "left")
        rows = rows.select("gram", F.expr(f"left(gram, {k})").alias("context"), F.expr(f"right(gram, {k})").alias("tail"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("ga", "gr")])
        if before is None:
            start = F.lit(1 / ALPHABET)
            rows = rows.select("*", F.lit(total["a"] or 0).alias("ca"), F.lit(total["r"] or 0).alias("cr"), start.alias("pa"), start.alias("pr"))
        else:
            contexts = grams.groupBy(F.expr(f"left(gram, {k})").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
            rows = rows.join(contexts, "context", "left").join(before, "tail", "left")
            rows = rows.select("gram", "ga", "gr", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("cr", F.lit(0)).alias("cr"), "pa", "pr")
        blend = lambda g, c, p: (F.col(g).cast("double") + PRIOR * F.col(p)) / (F.col(c).cast("double") + PRIOR)
        before = rows.select(F.col("gram").alias("tail"), blend("ga", "ca", "pa").alias("pa"), blend("gr", "cr", "pr").alias("pr"))
    return before.select(F.col("tail").alias("window"), F.round((F.log("pa") - F.log("pr")) * 1e6).cast("long").alias("ratio"))


def judge(df: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """All columns of df in a struct ``row``, then host, path, rule, verdict."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = parse(url)
    pages = df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("row"), url.alias("url"), host.alias("host"), path.alias("path"))
    pages = pages.select("row", "url", "host", "path", fitting(rules).alias("fit"))
    seen = pages.groupBy("url", F.col("fit.verdict").alias("label")).count()
    names = staged(seen.select("url", "label", "count", F.monotonically_increasing_id().alias("n")), "url-names")
    # Each URL becomes a row for each of its characters, so there are more tasks than names alone would get.
    cut = names.repartition(partitions(df.sparkSession), "n").withColumn("held", F.crc32("url") % HELD_OUT == 0)
    cut = cut.select("n", "label", "count", "held", F.explode(windows(F.col("url"))).alias("window"))
    learn, asked = cut.where("label IS NOT NULL AND NOT held"), cut.where("label IS NULL OR held").select("n", "window")
    if_label = lambda x: F.sum(F.when(F.col("label") == x, F.col("count")).otherwise(0))
    counts = staged(learn.groupBy("window").agg(if_label("allow").alias("a"), if_label("block").alias("r")), "url-counts")
    wanted = staged(asked.groupBy("window").count(), "url-windows")
    ratios = staged(window_ratios(counts, wanted.select("window")), "url-ratios")
    scores = lookup(asked, ratios, "window", wanted).groupBy("n").agg((F.sum("ratio") / F.count("*") / 1e6).alias("score"))
    scores = staged(names.select("n", "url", "label", "count").join(scores, "n").drop("n"), "url-scores")
    by = lambda f, x: f(F.when(F.col("label") == x, F.col("score")))
    stats = tuple(scores.agg(by(F.avg, "allow"), by(F.avg, "block"), by(F.stddev_pop, "allow"), by(F.stddev_pop, "block")).first())
    learnt = counts.agg(F.sum("a"), F.sum("r")).first()
    threshold = 0.0
    if None not in stats and stats[2] + stats[3] > 0:
        threshold = round((stats[0] * stats[3] + stats[1] * stats[2]) / (stats[2] + stats[3]), 6)
    trained = bool(learnt[0]) and bool(learnt[1])
    said = F.when(F.lit(not trained) | (F.round("score", 6) >= (threshold if trained else 0.0)), "allow").otherwise("block")
    free = scores.where(F.col("label").isNull())
    verdicts, often = free.select("url", said.alias("said")), free.select("url", "count")
    ruled = pages.where(F.col("fit").isNotNull()).select("row", "host", "path", "fit.rule", "fit.verdict")
    free = lookup(pages.where(F.col("fit").isNull()), verdicts, "url", often)
    return ruled.unionByName(free.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.col("said").alias("verdict")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    from .common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
OP10_SQL = f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, coalesce(url, '') AS name FROM pages
), fitted AS (
  SELECT *, CASE {_FITS} END AS fit FROM parsed
), pages_ AS (
  SELECT page_id, host, path, name, split_part(fit, '|', 1) AS rule, split_part(fit, '|', 2) AS label, fit IS NULL AS free FROM fitted
), names AS (
  SELECT name, label, free, count(*) AS n FROM pages_ GROUP BY ALL
), crc AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)
), tab AS (SELECT list(v ORDER BY i) AS t FROM crc
), held AS (
  SELECT names.*, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || hex[2 * j + 1 : 2 * j + 2])::BIGINT for j in range(len(hex) // 2)]),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {HELD_OUT} = 0 AS held
  FROM (SELECT *, hex(encode(name)) AS hex FROM names) names, tab
), cutup AS (
  SELECT *, substring(repeat(chr(2), {ORDER}) || name || chr(3), i::BIGINT, {ORDER + 1}) AS win
  FROM (SELECT *, unnest(range(1, length(name) + 2)) AS i FROM held)
), counts AS (
  SELECT win, CAST(coalesce(sum(n) FILTER (label = 'allow'), 0) AS BIGINT) AS a, CAST(coalesce(sum(n) FILTER (label = 'block'), 0) AS BIGINT) AS r
  FROM cutup WHERE NOT free AND NOT held GROUP BY win
), cut AS (SELECT *, right(win, k + 1) AS gram, substring(win, {ORDER} + 1 - k, k) AS context FROM counts, (SELECT unnest(range({ORDER + 1})) AS k)
), grams AS (SELECT gram, sum(a) AS ga, sum(r) AS gr FROM cut GROUP BY gram
), contexts AS (SELECT k, context, sum(a) AS ca, sum(r) AS cr FROM cut GROUP BY k, context
), steps AS (
  SELECT win, k, coalesce(ga, 0)::DOUBLE AS ga, coalesce(gr, 0)::DOUBLE AS gr, coalesce(ca, 0)::DOUBLE AS ca, coalesce(cr, 0)::DOUBLE AS cr
  FROM (SELECT *, right(win, k + 1) AS gram, substring(win, {ORDER} + 1 - k, k) AS context
        FROM (SELECT DISTINCT win FROM cutup WHERE free OR held), (SELECT unnest(range({ORDER + 1})) AS k))
  LEFT JOIN grams USING (gram) LEFT JOIN contexts USING (k, context)
), lists AS (
  SELECT win, list(ga ORDER BY k) AS ga, list(gr ORDER BY k) AS gr, list(ca ORDER BY k) AS ca, list(cr ORDER BY k) AS cr FROM steps GROUP BY win
), ratios AS (
  SELECT win, CAST(round((ln(list_reduce(list_prepend(1 / {ALPHABET}::DOUBLE, range(1, {ORDER + 2})::DOUBLE[]), lambda p, k: (ga[k::INT] + {PRIOR}::DOUBLE * p) / (ca[k::INT] + {PRIOR}::DOUBLE)))
       - ln(list_reduce(list_prepend(1 / {ALPHABET}::DOUBLE, range(1, {ORDER + 2})::DOUBLE[]), lambda p, k: (gr[k::INT] + {PRIOR}::DOUBLE * p) / (cr[k::INT] + {PRIOR}::DOUBLE)))) * 1e6) AS BIGINT) AS ratio FROM lists
), scores AS (
  SELECT name, label, free, sum(ratio)::DOUBLE / count(*) / 1e6::DOUBLE AS score FROM cutup JOIN ratios USING (win) WHERE free OR held GROUP BY ALL
), stats AS (
  SELECT avg(score) FILTER (label = 'allow') AS ma, avg(score) FILTER (label = 'block') AS mr,
         stddev_pop(score) FILTER (label = 'allow') AS sa, stddev_pop(score) FILTER (label = 'block') AS sr FROM scores
), bar AS (
  SELECT coalesce(round((ma * sr + mr * sa) / nullif(sa + sr, 0), 6), 0) AS bar, (SELECT sum(a) > 0 AND sum(r) > 0 FROM counts) AS trained FROM stats
)
SELECT page_id, p.host, p.path, CASE WHEN NOT p.free THEN p.rule END AS rule,
       CASE WHEN NOT p.free THEN p.label WHEN NOT coalesce(trained, false) OR round(score, 6) >= bar THEN 'allow' ELSE 'block' END AS verdict
FROM pages_ p LEFT JOIN scores s ON p.free AND s.free AND p.name = s.name, bar
"""
