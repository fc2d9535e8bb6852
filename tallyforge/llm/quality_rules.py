"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far each may be trusted.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains (0). The votes of the whole corpus,
grouped by pattern (at most 3 ** rules rows, whatever the corpus), go to the driver, where expectation-maximisation
fits a two-class model: a prior, and for each rule and class the probability of each vote. A document's posterior
probability of good quality then decides, instead of "all rules must pass".

Defined cases: a null text counts as empty; an empty text has no words and fails the base rules; repeated rows are judged
alike, one by one; an empty table gives an empty result; other columns, also ones with clashing names, pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COMMON_WORDS, in_parts, small_batches, staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
FEW_WORDS = 20  # fewer than these may well have no common word

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_letters long, n_bangs long, n_bars long, n_stops long, n_ends long"
)

def count_text(text: bytes | None) -> tuple[int, ...]:
    """The counts of one UTF-8 text, in the order of COUNTS."""
    text = text or b""
    words = text.split()
    n = len(words)
    white = len(text) - len(text.translate(None, _WHITE))
    points = len(text if text.isascii() else text.translate(None, _CONTINUATION))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            end = 0  # words before it are counted already
            for i, x in enumerate(windows):
                if seen[x] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    lower = len(text) - len(text.translate(None, _LOWER))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        n,
        points - white,
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        lower + upper,
        text.count(b"!"),
        text.count(b"|"),
        sum(map(COMMON_WORDS.__contains__, map(bytes.lower, words))),
        text.count(b".") + text.count(b"!") + text.count(b"?"),
    )


_WHITE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _count_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for batch in texts:
        counts = np.array([count_text(x) for _, some in in_parts(batch) for x in some], np.int64).reshape(len(batch), len(names))
        yield pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names)


def _counts(text: Column) -> Column:
    return F.arrow_udf(_count_batches, COUNTS)(text)


def base_failed(c: Column, min_words: int = MIN_WORDS) -> Column:
    """Too short, or mostly repeated three-word windows."""
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def votes(c: Column) -> list[Column]:
    """The rules; each is good (1), bad (-1) or abstains (0) for a struct of counts."""
    n, lines = c["n_words"].cast("double"), c["n_lines"].cast("double")

    def rule(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")

    per_word = lambda name: F.when(n > 0, c[name] / n)
    symbols, bangs, bars = per_word("n_symbols"), per_word("n_bangs"), per_word("n_bars")
    repeats, stops, ends, length = per_word("n_repeat_words"), per_word("n_stops"), per_word("n_ends"), per_word("word_chars")
    upper = F.when(c["n_letters"] > 0, c["n_upper"] / c["n_letters"].cast("double"))
    again = F.when(lines > 0, c["n_dup_lines"] / lines)
    return [
        rule(symbols, symbols <= 0.05, symbols > 0.25),
        rule(upper, upper <= 0.15, upper > 0.3),
        rule(bangs, bangs <= 0.05, bangs > 0.2),
        rule(bars, bars <= 0.05, bars > 0.2),
        rule(repeats, repeats <= 0.1, repeats > 0.3),
        rule(again, again <= 0.1, again > 0.3),
        rule(stops, stops >= 0.1, (stops < 0.04) & (n >= FEW_WORDS)),
        rule(ends, (ends >= 0.02) & (ends <= 0.3), (ends < 0.01) | (ends > 0.6)),
        rule(length, (length >= 3) & (length <= 9), (length < 2.5) | (length > 14)),
    ]


def expectation_maximisation(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(prior of good, table[class, rule, vote + 1]) for vote patterns and how many documents show each.

    Class 1 is good. Each row of the table has Dirichlet pseudo counts that say a vote is more often right than wrong,
    which also keeps the classes from trading places. Starts from "one bad vote makes a document bad".
    """
    rules = patterns.shape[1] if patterns.ndim == 2 else 0
    prior, table = 0.8, np.full((2, rules, 3), 1 / 3)
    if not len(patterns) or not rules:
        return prior, table
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    pseudo = np.array([[2.0, 1.0, 1.0], [0.1, 1.0, 2.0]])[:, None, :]
    good = np.where((patterns < 0).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        share = np.stack([weights * (1 - good), weights * good])
        table = np.einsum("cp,prv->crv", share, hot) + pseudo
        table /= table.sum(axis=2, keepdims=True)
        prior = (share[1].sum() + 8) / (weights.sum() + 10)
        bad_log, good_log = (np.einsum("prv,rv->p", hot, np.log(table[c])) for c in (0, 1))
        z = np.clip(good_log - bad_log + np.log(prior / (1 - prior)), -500, 500)
        new = 1 / (1 + np.exp(-z))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(prior), table


def judged(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (row struct, c struct of counts, base_failed, posterior, kept); the counts are computed once and staged."""
    carried = df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns if x != text_col]).alias("row") if len(df.columns) > 1 else F.lit(None).cast("struct<x:int>").alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    with small_batches(df.sparkSession):
        counted = staged(carried.select("row", _counts(F.col("text")).alias("c")), "quality-counts")
    return _posterior(counted)


def _posterior(counted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    ballots = counted.select("*", F.array(*votes(F.col("c"))).alias("votes"))
    seen = ballots.groupBy("votes").count().collect()  # at most 3 ** rules rows
    rules = len(votes(F.col("c")))
    patterns, weights = np.array([x["votes"] for x in seen], np.int64).reshape(len(seen), rules), np.array([x["count"] for x in seen], float)
    order = np.lexsort(patterns.T) if len(seen) else []
    prior, fitted = expectation_maximisation(patterns[order], weights[order])
    ratio = np.log(fitted[1]) - np.log(fitted[0])
    score = F.lit(float(np.log(prior / (1 - prior))))
    for r in range(ratio.shape[0]):
        v = F.col("votes")[r]
        score = score + F.when(v < 0, float(ratio[r, 0])).when(v == 0, float(ratio[r, 1])).otherwise(float(ratio[r, 2]))
    posterior = (1 / (1 + F.exp(-score))).alias("posterior")
    out = ballots.select("*", posterior, base_failed(F.col("c"), min_words).alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))


def keep_good(df: DataFrame, text_col: str = "text", min_words: int = 1) -> DataFrame:
    """The rows that pass the base rules and the posterior, with all their columns and nothing else.

    Texts are not turned away for their length alone, as min_words is 1 here: about one clean text in twenty has under
    MIN_WORDS words, and the posterior tells those from junk.
    The rows are staged with their counts, so no key is needed to find a verdict again.
    """
    whole = F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("row")
    with small_batches(df.sparkSession):
        counted = staged(df.select(whole, F.col(f"`{text_col}`").cast("binary").alias("text")).select("row", _counts(F.col("text")).alias("c")), "quality-rows")
    return _posterior(counted, min_words).where("kept").select("row.*")


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    """doc_id, the base counts and both verdicts for every document."""
    from .common import table

    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [F.col(f"c.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select(F.col("row.doc_id").alias("doc_id"), *base, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
