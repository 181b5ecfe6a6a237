"""URL filter: rule list first, then a likelihood ratio of two smoothed variable-order Markov models of characters.

All of it is DataFrame code. Contexts of zero to three characters are blended by Witten-Bell weights; a
context that a class has never seen passes the question on to the next shorter one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path) of the rules. Fixed values of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
#: Characters a model can see: a-z, one for digits, some marks, one for the rest, start and end.
ALPHABET = 26 + 1 + 12 + 1 + 2
#: A model of this many n-grams at most is broadcast (about 30 MB); a larger one is joined by shuffle.
BROADCAST_GRAMS = 300_000
BIN = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _symbols(host: Column, path: Column) -> Column:
    """The string a model reads: start marks, folded characters, end mark."""
    folded = F.regexp_replace(F.translate(F.concat(host, path), UPPER + "0123456789", LOWER + "0" * 10), r"[^a-z0/.\-_~%+=&:,@]", "*")
    return F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("$"))


def _grams(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per character: the gram of ORDER characters that ends there."""
    at = F.explode(F.sequence(F.lit(1), F.length("_s") - (ORDER - 1))).alias("_i")
    return df.select(*keep, "_s", at).select(*keep, F.substring(F.col("_s"), F.col("_i"), F.lit(ORDER)).alias("gram"))


def fit_ratio(train: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, delta): log P(last character | the ones before) under accepted minus rejected, for each asked gram.

    ``train`` has _accepted (boolean) and _s. Counts are sums over all of it; every table below has at
    most ALPHABET ** ORDER rows, whatever the number of URLs.
    """
    n = _grams(train, ["_accepted"]).groupBy("gram").agg(
        F.count_if("_accepted").alias("a"), F.count_if(~F.col("_accepted")).alias("r")
    )
    n = written(n)
    out = grams.select("gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    for k in range(1, ORDER + 1):
        tail = F.substring(F.col("gram"), F.lit(ORDER - k + 1), F.lit(k))
        num = n.groupBy(tail.alias("g")).agg(F.sum("a").alias("ga"), F.sum("r").alias("gr"))
        head = num.groupBy(F.substring(F.col("g"), F.lit(1), F.lit(k - 1)).alias("h")).agg(
            F.sum("ga").alias("ha"), F.sum("gr").alias("hr"),
            F.count_if(F.col("ga") > 0).alias("ta"), F.count_if(F.col("gr") > 0).alias("tr"),
        )
        out = out.withColumn("g", tail).withColumn("h", F.substring(F.col("g"), F.lit(1), F.lit(k - 1)))
        out = out.join(num, "g", "left").join(head, "h", "left").na.fill(0, ["ga", "gr", "ha", "hr", "ta", "tr"])
        for c in "ar":
            total = F.col(f"h{c}") + F.col(f"t{c}")
            blended = (F.col(f"g{c}") + F.col(f"t{c}") * F.col(f"p{c}")) / total
            out = out.withColumn(f"p{c}", F.when(total > 0, blended).otherwise(F.col(f"p{c}")))
        out = out.select("gram", "pa", "pr")
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("delta"))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row: the cut that best balances the error rates of labelled, held-out scores.

    Scores are counted in bins of BIN over [-8, 8], so the table that is searched has 1601 rows at most.
    Without labelled rows of both classes the cut is 0.
    """
    bins = (
        scored.groupBy(F.round(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("score"))) / BIN).cast("int").alias("bin"))
        .agg(F.count_if("_accepted").alias("a"), F.count_if(~F.col("_accepted")).alias("r"))
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    cut = bins.select(
        # halfway to the next lower score that was seen
        ((F.col("bin") + F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin") - 1)) / 2).alias("bin"),
        (F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)).alias("lost"),
        (1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)).alias("let"),
        (F.sum("a").over(every) * F.sum("r").over(every)).alias("both"),
    ).where("both > 0")
    best = cut.agg(F.min(F.struct((F.col("lost") + F.col("let")).alias("e"), F.abs("bin").alias("d"), "bin")).alias("m"))
    return best.select(F.coalesce(F.col("m.bin") * F.lit(BIN), F.lit(0.0)).alias("cut"))


def judge_urls(
    df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Verdict for each row: the longest fitting rule's, else the models'.

    Rules label the training URLs: allowed ones are accepted, blocked ones rejected; four fifths (by a
    hash of the URL) fit the models and one fifth sets the cut on the mean difference per character.
    A null URL, or one without ``://``, has an empty host and path and is judged by the models like any
    other. If rules leave a class empty, both models know nothing of it and the uniform law stands in.
    Repeated rows each get a row. Other columns are not carried; an empty table gives an empty result.
    """
    base = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.select(
        key, "host", "path",
        _by_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"),
        _by_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("_ruled"),
        _symbols(F.col("host"), F.col("path")).alias("_s"),
    )
    # equal strings are scored once: a hot host's common paths do not multiply the work
    labelled = base.where("_ruled is not null").groupBy("_s").agg((F.max("_ruled") == "allow").alias("_accepted"))
    held = F.pmod(F.xxhash64(F.lit("held"), F.col("_s")), F.lit(5)) == 0
    strings = base.select("_s").distinct()
    asked = written(_grams(strings, []).distinct())
    model = written(fit_ratio(labelled.where(~held), asked))
    small = model.count() <= BROADCAST_GRAMS
    side = F.broadcast(model) if small else model
    per = _grams(strings, ["_s"]).withColumn("_n", F.lit(1))
    if not small:  # the join is a shuffle by gram then: counted per string first, and skew is left to adaptive splitting
        per = per.groupBy("_s", "gram").agg(F.sum("_n").alias("_n"))
    scores = written(
        per.join(side, "gram").groupBy("_s").agg((F.sum(F.col("delta") * F.col("_n")) / F.sum("_n")).alias("score"))
    )
    cut = calibrate(scores.join(labelled.where(held), "_s"))
    return (
        base.join(scores, "_s", "left")
        .select(
            key, "host", "path", "rule",
            F.coalesce("_ruled", F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block")).alias("verdict"),
            F.round("score", 6).alias("score"),
        )
    )
