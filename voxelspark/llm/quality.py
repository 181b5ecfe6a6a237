"""Quality rules on documents and on their hosts, in DataFrame code only.

A host's failure rate is shrunk towards the corpus by a beta prior whose two parameters come from the
hosts themselves (moments). The verdict on the host goes back to its documents: in a host that fails
often one soft failure is enough to reject a document, elsewhere it takes two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positional, written

MIN_WORDS = 50
#: Soft rules: more symbols than a tenth of the words, more than 3 of 10 lines repeated, mean word length outside 3 to 12.
SYMBOLS_PER_100, DUP_LINES_PER_100, WORD_LENGTH = 10, 30, (3, 12)
#: A host whose shrunk failure rate is above this is strict.
STRICT_RATE = 0.5
#: So many hosts at most are broadcast; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 100_000

#: Columns that the rules add to a row.
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft")

_WORDS = r"filter(split(translate(_t, '\u0009\u000a\u000b\u000c\u000d', '     '), ' '), w -> w != '')"
#: Windows of three words as longs: 38 bits of hash above 25 bits of position, so that a sort of longs
#: puts equal windows side by side, in order. Longer texts (2^25 words) shift by 31 bits.
_BITS = "if(size(_w) < 33554432, 25, 31)"
_KEYS = f"""if(size(_w) < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, size(_w) - 3),
 i -> shiftleft(shiftrightunsigned(xxhash64(_w[i], _w[i + 1], _w[i + 2]), {_BITS} + 1), {_BITS}) | cast(i as bigint))))"""
#: Positions of windows that share their 38 bits with another one: all repeated windows, and a few more by chance.
_MAYBE = f"""if(size(_k) < 2, cast(array() as array<int>), transform(filter(sequence(0, size(_k) - 1),
 i -> (i > 0 and shiftright(_k[i], {_BITS}) = shiftright(_k[i - 1], {_BITS}))
 or (i < size(_k) - 1 and shiftright(_k[i], {_BITS}) = shiftright(_k[i + 1], {_BITS}))),
 i -> cast(_k[i] & (shiftleft(cast(1 as bigint), {_BITS}) - 1) as int)))"""
#: Those windows by their words (no word holds a space), sorted: equal ones stand side by side, whatever their hashes.
_SORTED = "array_sort(transform(_m, p -> struct(concat(_w[p], ' ', _w[p + 1], ' ', _w[p + 2]) as w, p as p)))"
#: Positions of the windows that occur twice or more, in order.
_REPEATED = """if(size(_s) < 2, cast(array() as array<int>), sort_array(transform(filter(sequence(0, size(_s) - 1),
 i -> (i > 0 and _s[i].w = _s[i - 1].w) or (i < size(_s) - 1 and _s[i].w = _s[i + 1].w)), i -> _s[i].p)))"""
#: A window covers three words, or as many as the next repeated window leaves it.
_COVERED = """if(size(_r) = 0, 0L, 3L + cast(aggregate(sequence(1, greatest(size(_r) - 1, 1)), 0,
 (s, i) -> s + if(i < size(_r), least(3, _r[i] - _r[i - 1]), 0)) as bigint))"""


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the columns METRICS: counts, base_failed and soft (the number of soft rules failed).

    All from the whole text; a null or empty one counts 0 everywhere and fails for want of words. A column
    of the input that has one of these names is replaced; no other name clashes. One pass, no shuffle; work
    per text is n log n in its words. Repeated windows are told by their words, hashes only narrow the search.
    """
    names = [c for c in df.columns if c not in METRICS]
    rows, (text,) = positional(df.select(*names), text)
    lines = r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    out = rows.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", F.expr(_WORDS))
    for name, made in (("_k", _KEYS), ("_m", _MAYBE), ("_s", _SORTED), ("_r", _REPEATED), ("_l", lines)):
        out = out.withColumn(name, F.expr(made))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_lines": F.size("_l").cast("long"),
        "n_repeat_words": F.expr(_COVERED),
    })
    words = F.col("n_words")
    soft = [
        100 * F.col("n_symbols") > SYMBOLS_PER_100 * words,
        100 * F.col("n_dup_lines") > DUP_LINES_PER_100 * F.col("_lines"),
        (F.col("word_chars") < WORD_LENGTH[0] * words) | (F.col("word_chars") > WORD_LENGTH[1] * words),
    ]
    out = out.withColumn("base_failed", (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * words))
    out = out.withColumn("soft", sum((x.cast("int") for x in soft), F.lit(0)))
    return out.select(*rows.columns, *METRICS).toDF(*names, *METRICS)


def host_rates(metrics: DataFrame, host: str = "source") -> DataFrame:
    """(host, docs, failed, rate): failures by host, shrunk by a beta prior fitted to the hosts' own rates.

    With mean m and variance v of the hosts' rates the prior has weight s = m(1 - m)/v - 1 and the rate is
    (failed + s m)/(docs + s). One host, or equal rates, gives v = 0: then s is 100 documents; s stays in 1 to 1000.
    """
    failing = (F.col("base_failed") | (F.col("soft") > 0)).cast("long")
    by = metrics.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("docs"), F.sum(failing).alias("failed"))
    by = written(by)
    of = by.agg(F.avg(F.col("failed") / F.col("docs")).alias("m"), F.var_samp(F.col("failed") / F.col("docs")).alias("v"))
    m = of.select(F.coalesce("m", F.lit(0.0))).scalar()
    weight = of.select(
        F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(100.0)))
    ).scalar()
    return by.withColumn("rate", (F.col("failed") + weight * m) / (F.col("docs") + weight))


def _judged(rows: DataFrame, host: str) -> DataFrame:
    """Rows that have METRICS, each with host_rate and kept; they are read twice, their texts once."""
    hosts = written(host_rates(rows.select(host, "base_failed", "soft"), host).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")))
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    out = rows.join(side, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    limit = F.when(F.col("host_rate") > STRICT_RATE, 1).otherwise(2)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("soft") < limit))


def apply_rules(df: DataFrame, host: str = "source", text: str = "text", texts: bool = True) -> DataFrame:
    """The rows with METRICS, ``host_rate`` and ``kept``; without ``texts`` the text itself stays out.

    kept is false if base_failed; else false for two soft failures, or for one in a strict host. A document
    that fails nothing is kept whatever its host. A null host is a host of its own. Repeated rows count as
    often as they stand there. An empty table gives an empty result. Columns of the input with the names of
    the new ones are replaced. Texts are measured once: the rows with their numbers are written to the shared
    folder, hosts are counted and verdicts joined from there. Hosts are broadcast while they are few enough
    (their number is checked); beyond, the rows are shuffled by host and skewed hosts split.
    """
    new = (*METRICS, "host_rate", "kept")
    names = [c for c in df.columns if c not in new or c == host]
    rows, (host, text) = positional(df.select(*names), host, text)
    stay = [(c, n) for c, n in zip(rows.columns, names, strict=True) if texts or c != text]
    measured = written(with_metrics(rows, text).select(*(c for c, _ in stay), *METRICS))
    return _judged(measured, host).select(*(c for c, _ in stay), *new).toDF(*(n for _, n in stay), *new)


def keep_documents(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns they came with. Nulls, empty texts and repeats as in apply_rules."""
    rows, (host, text) = positional(df, host, text)
    out = with_metrics(rows, text)
    # a text that goes whatever its host need not be written
    may = F.when(~F.col("base_failed") & (F.col("soft") < 2), F.col(text))
    measured = written(out.withColumn(text, may).select(*rows.columns, "base_failed", "soft"))
    return _judged(measured, host).where("kept").select(*rows.columns).toDF(*df.columns)


__all__ = ["METRICS", "apply_rules", "host_rates", "keep_documents", "with_metrics"]
