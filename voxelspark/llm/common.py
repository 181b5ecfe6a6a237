"""Helpers shared by the text operators: reading tables, cutting lineage, hashing in numpy."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space; words are maximal runs of anything else.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; only they are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows under the column names c0, c1, ..., and the new names of some columns.

    Operators that hand on all columns work on these, so no column of the input can clash with theirs.
    """
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), [f"c{df.columns.index(n)}" for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session has none (local tests) is a local one set.
    """
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return str(here.get())
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = f"file://{tempfile.mkdtemp(dir='/tmp/checkpoints')}"
    sc.setCheckpointDir(base)
    return str(sc._jsc.sc().getCheckpointDir().get())


#: Tables that written() made in this process and nothing has deleted yet, oldest first.
_tables: dict[str, None] = {}


def written(df: DataFrame) -> DataFrame:
    """The DataFrame, written once as Parquet into the shared folder and read back.

    Lineage ends there; a lost executor costs a re-read, not a recomputation. The table stays until discard()
    deletes it: results may read it as long as the session lives.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    # its shuffle files are of no use once the table stands
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    _tables[path] = None
    return spark.read.schema(df.schema).parquet(path)


def noted(path: str) -> str:
    """A folder under the shared one that an operator writes itself, on record like a table."""
    _tables[path] = None
    return path


def tables() -> list[str]:
    """Paths of the written tables that still stand."""
    return list(_tables)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _tables.pop(path, None)


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """The rows with their number ``_at`` in the order of some columns: 0, 1, 2, ... over all rows.

    The order is made once, in ranges, and written; the start of each range is the sum of those before it
    (one row for each partition). So whoever reads it again sees the same numbers, whatever plans are reused.
    """
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_f"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn("_at", F.col("_f") + inside).drop("_p", "_f", "_m")


def in_blocks(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """Numbered rows dealt into blocks ``_b`` of ``size``; a block also gets the ``reach`` rows before and after its ``_own``."""
    if reach > size:
        raise ValueError("a block must be longer than the reach")
    own, place = F.floor(F.col("_at") / size), F.pmod(F.col("_at"), F.lit(size))
    near = F.array(own, F.when((place < reach) & (own > 0), own - 1), F.when(place >= size - reach, own + 1))
    return rows.withColumn("_b", F.explode(F.array_compact(near))).withColumn("_own", F.col("_b") == own)


def tidy() -> None:
    """Give memory that is free, but still held by the allocators of this process, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function of batches (a generator) or of a table for Spark's Python workers; what it freed leaves the process when it ends.

    A worker outlives its tasks, and others run beside it in the executor's memory.
    """
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def whole(batches):
            try:
                yield from run(batches)
            finally:
                tidy()

    else:

        @functools.wraps(run)
        def whole(t):
            try:
                return run(t)
            finally:
                tidy()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element; wraps on overflow."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n 64-bit constants that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = stream(0x5EED, 256)
_BASE = int(stream(0xBA5E, 1)[0]) | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    """Powers of the inverse of the base, n at least; kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inv = pow(_BASE, -1, 1 << 64)
        out = np.empty(size, dtype=U64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(pow(inv, done, 1 << 64))
                done += take
        _POWERS[:] = [out]
    return _POWERS[0]


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a byte buffer: 64-bit hash, start and end of each.

    A word is a maximal run without ASCII white space; A-Z count as a-z.
    """
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, U64), start, end
    with np.errstate(over="ignore"):
        inv = _powers(len(data) + 1)
        # term j is byte value times inverse power j; a word's sum times base**start is its own value
        terms = _BYTE[_LOWER[data] if lower else data] * inv[: len(data)]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64)))
        return mix((total[end] - total[start]) * _base_powers(len(data) + 1)[start] + (end - start).astype(U64)), start, end


_FORWARD: list[np.ndarray] = []


def _base_powers(n: int) -> np.ndarray:
    if not _FORWARD or len(_FORWARD[0]) < n:
        size = max(n, 1 << 20)
        out = np.empty(size, dtype=U64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(pow(_BASE, done, 1 << 64))
                done += take
        _FORWARD[:] = [out]
    return _FORWARD[0]


def text_words(text: bytes, lower: bool = True, block: int = 1 << 20) -> np.ndarray:
    """Hashes of the words of one text, in order; a long text is taken in blocks cut at white space."""
    if len(text) <= block:
        return word_hashes(np.frombuffer(text, np.uint8), lower)[0]
    parts, at = [], 0
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(word_hashes(np.frombuffer(text[at:end], np.uint8), lower)[0])
        at = end
    return np.concatenate(parts)


def chunks(texts: list[bytes], most: int = 1 << 19) -> list[tuple[int, int]]:
    """Runs [i, j) of texts of about ``most`` bytes together; a longer text stands alone."""
    out, i, held = [], 0, 0
    for j, t in enumerate(texts):
        if j > i and held + len(t) > most:
            out.append((i, j))
            i, held = j, 0
        held += len(t)
    if len(texts) > i:
        out.append((i, len(texts)))
    return out


def words_of_many(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, and the number of words of each."""
    if len(texts) == 1:
        words = text_words(texts[0], lower)
        return words, np.array([len(words)])
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    words, start, _ = word_hashes(data, lower)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words inside each text, and how many each has.

    A text of fewer words, but one at least, has its whole sequence as the only one.
    """
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    have = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(have.sum())
    owner = np.repeat(np.arange(len(counts)), have)
    at = np.arange(total) - np.repeat(np.cumsum(have) - have, have) + first[owner]
    take = np.minimum(counts, width)[owner]
    out = np.zeros(total, U64)
    factors = stream(0x51, width)
    with np.errstate(over="ignore"):
        for k in range(width):
            live = take > k
            out[live] = mix(out[live] + words[at[live] + k] * (factors[k] | U64(1)))
        out = mix(out + take.astype(U64))
    return out, have


def distinct_parts(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each part, joined, and their numbers."""
    parts, at = [], 0
    for n in counts.tolist():
        parts.append(np.unique(values[at : at + n]) if n > 1 else values[at : at + n])
        at += n
    return (np.concatenate(parts) if parts else values[:0]), np.array([len(p) for p in parts], dtype=np.int64)


#: Edges that the driver joins by itself, 16 bytes each; more are joined by rounds of shuffles.
FEW_EDGES = 1 << 17


def _joined(edges: pa.Table) -> pa.Table:
    """Nodes (u) and the smallest node of their component (v) where that is another, of edges (u, v)."""
    at: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := at.get(c, c)) != c:
            at[c] = c = at.get(up, up)
        return c

    for u, v in zip(*(edges.column(c).to_pylist() for c in "uv"), strict=True):
        u, v = root(u), root(v)
        if u != v:
            at[max(u, v)] = min(u, v)
    nodes = list(at)
    return pa.table({"u": pa.array(nodes, pa.int64()), "v": pa.array(map(root, nodes), pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of edges (a, b), component being the smallest node.

    Alternating large-star and small-star steps, each a grouped minimum and a join, until nothing moves.
    Edges stay distributed; each round is written to the shared folder. FEW_EDGES and less (counted) need no rounds:
    most of their time would go into starting tasks, so the driver joins them.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spark, mark = edges.sparkSession, None
    if e.count() <= FEW_EDGES:
        old = tables()[-1]
        e = written(spark.createDataFrame(_joined(e.toArrow()), "u long, v long"))
        discard(spark, [old])
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        old = tables()[-1]
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(small)
        discard(spark, [old])
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def tied(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of edges that are known, with some more edges (a, b); without any, nothing is joined anew."""
    if links.isEmpty():
        return known
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))
