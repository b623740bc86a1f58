"""Quality rules as weak supervision: every rule votes good, bad or abstains, and expectation-maximisation weighs the rules.

Everything on the main path is DataFrame and SQL expressions. Two passes over the texts are
avoided by writing the features to the shared folder once.

Defined cases: a null or empty text has no words and fails the base rule; null ids are kept as
they are; repeated rows are judged alike, each on its own; an empty table gives an empty result;
other columns are ignored by `features` and carried by `judge`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, materialize, read_table

#: The share of good documents is kept within these bounds.
PRIOR = (0.5, 0.98)
#: Where expectation-maximisation starts: the chance of a (bad, good) vote from a bad and from a good document.
START = {"bad": (0.4, 0.4), "good": (0.02, 0.8)}
#: A bad vote speaks against a document by at least, and at most, so many natural-log units; a good vote for it likewise.
BAD_VOTE, GOOD_VOTE = (0.7, 6.0), (0.0, 3.0)
#: Votes added to every count, at the starting rates.
SMOOTH = 10.0
ROUNDS = 12
KEEP_AT = 0.5

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, not_counted: str) -> Column:
    """Characters of text that are left when those of the class not_counted go."""
    return F.length(F.regexp_replace(text, f"{not_counted}++", "")).cast("long")


def features(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, and the numbers that the rules look at, for every whole text."""
    df = df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.split(F.expr(r"btrim(_t, ' \t\n\u000B\u000C\r')"), "[\\x20\\x09-\\x0D]+"))
    df = df.withColumn("_w", F.when(F.get("_w", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("_w")))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("_w")
    # A hash for each window of five words, by its first word's place.
    df = df.withColumn("_h", F.expr("if(size(_w) < 5, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i+1], _w[i+2], _w[i+3], _w[i+4])))"))
    # Only texts in which a window repeats are sorted: the windows of one hash then stand side by side.
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>))"))
    df = df.withColumn("_p", F.expr("sort_array(filter(transform(_s, (e, j) -> if(e.h = get(_s, j - 1).h or e.h = get(_s, j + 1).h, e.i, -1)), i -> i >= 0))"))
    covered = F.expr("aggregate(transform(_p, (p, k) -> least(5, coalesce(get(_p, k + 1) - p, 5))), 0L, (a, x) -> a + x)")
    joined = F.array_join("_w", "")
    return df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        _count(F.col("_t"), "[^#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _count(F.col("_t"), "[^A-Z\u00C0-\u00DE\u0391-\u03A9\u0410-\u042F]").alias("n_upper"),
        _count(F.col("_t"), "[^!?]").alias("n_bangs"),
        F.expr("regexp_count(_t, '[#*$%&|<>]{2,}|(?<=[ \\n])[|](?=[ \\n])')").cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 to abstain, by rule."""
    c = F.col
    words, chars, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": rule(c("n_words") < 10, c("n_words") >= 40),
        "word_length": rule((chars < 2 * words) | (chars > 14 * words), (chars >= 3 * words) & (chars <= 10 * words)),
        "symbols": rule(c("n_symbols") * 10 > words, c("n_symbols") * 50 <= words),
        "symbol_chars": rule(c("n_symbols") * 100 > chars * 3, c("n_symbols") * 200 <= chars),
        "marks": rule(c("n_marks") * 20 > words, c("n_marks") * 100 <= words),
        "repeats": rule(c("n_repeat_words") * 100 > words * 15, c("n_repeat_words") * 100 <= words * 3),
        "lines": rule(c("n_dup_lines") * 10 > lines * 3, (c("n_dup_lines") == 0) & (lines > 2)),
        "shouting": rule(c("n_upper") * 100 > chars * 30, c("n_upper") * 100 <= chars * 10),
        "bangs": rule(c("n_bangs") * 10 > words, F.lit(False)),
    }


Weights = dict[str, tuple[float, float]]


def _posterior(prior: float, weights: Weights) -> Column:
    """The probability that a document with these votes is good; weights has what a bad and a good vote add to the log-odds."""
    # One array literal: its values are passed to the compiled code, which stays the same from round to round.
    table = [x for bad, good in weights.values() for x in (bad, 0.0, good)]
    table[:3] = [x + math.log(prior / (1 - prior)) for x in table[:3]]
    values = ", ".join(f"{x!r}D" for x in table)
    odds = " + ".join(f"get(array({values}), v_{name} + {3 * j + 1})" for j, name in enumerate(weights))
    return F.expr(f"1 / (1 + exp(-({odds})))")


def _weights(rates: dict[str, dict[str, tuple[float, float]]]) -> Weights:
    out = {}
    for r, x in rates.items():
        bad = math.log(x["bad"][0] / x["good"][0])
        good = math.log(x["good"][1] / x["bad"][1])
        out[r] = (-min(max(bad, BAD_VOTE[0]), BAD_VOTE[1]), min(max(good, GOOD_VOTE[0]), GOOD_VOTE[1]))
    return out


def estimate(patterns: DataFrame, rules: list[str]) -> tuple[float, Weights]:
    """(share of good documents, log-odds weights by rule) by expectation-maximisation over vote patterns.

    patterns has v_<rule> columns and a count `n`; there are at most 3**len(rules) of them. A rule's
    accuracy is how often it votes good and bad on documents of either kind; a rule that abstains says
    nothing. Every round is one aggregation that returns one row. Without any pattern the starting values stay.
    """
    prior, rates = 0.85, {r: dict(START) for r in rules}
    for _ in range(ROUNDS):
        scored = patterns.withColumn("good", _posterior(prior, _weights(rates)) * F.col("n"))
        sums = [f"sum({k}) AS {k}" for k in ("n", "good")]
        sums += [f"sum(if(v_{r} = {v}, {k}, 0)) AS `{k}{v}_{r}`" for r in rules for v in (-1, 1) for k in ("good", "n")]
        row = scored.selectExpr(*sums).first().asDict()
        if not row["n"]:
            break
        prior = round(min(max(row["good"] / row["n"], PRIOR[0]), PRIOR[1]), 9)
        row |= {k.replace("n", "bad", 1): x - row[k.replace("n", "good", 1)] for k, x in row.items() if k[0] == "n"}
        rates = {r: {k: tuple(round((row[f"{k}{v}_{r}"] + SMOOTH * START[k][v > 0]) / (row[k] + SMOOTH), 9) for v in (-1, 1)) for k in ("bad", "good")} for r in rules}
    return prior, _weights(rates)


def judge(spark: SparkSession, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the features, `base_failed`, `quality` (posterior that the document is good) and `kept`."""
    rules = votes()
    found = features(df, keep).select("*", *(v.cast("tinyint").alias(f"v_{r}") for r, v in rules.items()))
    found = materialize(spark, found, "quality")
    patterns = materialize(spark, found.groupBy(*(f"v_{r}" for r in rules)).agg(F.count("*").alias("n")).coalesce(1), "votes")
    prior, weights = estimate(patterns, list(rules))
    return found.select(
        *keep, *FEATURES, base_failed().alias("base_failed"), _posterior(prior, weights).alias("quality"), *(f"v_{r}" for r in rules)
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *FEATURES, "base_failed", "kept", "quality")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. The texts are judged once, in the scan, and written with their votes: a filter on
    the votes would otherwise be pushed below them, and repeat what they are made of many times over."""
    rules = votes()
    wide = features(docs.withColumn("_row", F.struct(*columns(docs))), ["_row"])
    wide = materialize(spark, wide.select("_row", base_failed().alias("failed"), *(v.cast("tinyint").alias(f"v_{r}") for r, v in rules.items())), "judged")
    counted = wide.groupBy(*(f"v_{r}" for r in rules)).agg(F.count("*").alias("n"))
    prior, weights = estimate(materialize(spark, counted.coalesce(1), "votes"), list(rules))
    return wide.filter(~F.col("failed") & (_posterior(prior, weights) >= KEEP_AT)).select("_row.*")
