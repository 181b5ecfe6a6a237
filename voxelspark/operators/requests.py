"""Request files: axis, type and index of the slices asked for. Parsing, checks, hash, generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address
from ..meta import AXES, VolumeMeta

KINDS = ("random", "continuous")
RANDOM_COUNT, CONTINUOUS_COUNT = 100, 10
#: FNV-1a with 64 bits. Fixed values.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def parse(lines: DataFrame, text: str = "value", number: str = "line") -> DataFrame:
    """(line, axis, type, index, error) of each line that says something; error is null for a good line.

    Fields are parted by commas, tabs or spaces. A byte order mark, blank lines, comments (#) and the header
    axis,type,index are passed over; letters count without case.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"[,\t\r\n]+", " "))
    fields = F.split(F.lower(F.regexp_replace(clean, r" +", " ")), " ")
    rows = lines.select(F.col(number).alias("line"), clean.alias("_c"), fields.alias("_f"))
    rows = rows.where("_c <> '' and not startswith(_c, '#') and concat_ws('', _f) <> 'axistypeindex'")
    get = lambda k: F.get("_f", F.lit(k))
    shaped = (F.size("_f") == 3) & get(2).rlike(r"^[0-9]{1,18}$")
    known = get(0).isin(*AXES) & get(1).isin(*KINDS)
    error = F.when(~F.coalesce(shaped, F.lit(False)), F.concat(F.lit('expected "axis,type,index", got "'), F.col("_c"), F.lit('"'))).when(
        ~known, F.concat(F.lit("unknown axis/type: "), get(0), F.lit("/"), get(1))
    )
    return rows.select("line", get(0).alias("axis"), get(1).alias("type"), F.when(F.coalesce(shaped, F.lit(False)), get(2).cast("long")).alias("index"), error.alias("error"))


def numbered(parsed: DataFrame) -> DataFrame:
    """(axis, type, seq, index): requests with their place in their group, in file order. An error line raises."""
    rows = parsed.select("line", "axis", "type", "index", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("error")))).cast("int").alias("_e"))
    seq = F.row_number().over(Window.partitionBy("axis", "type").orderBy("line")) - 1
    return rows.where("_e is null").select("axis", "type", seq.cast("int").alias("seq"), "index")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a file; lines are numbered from 1. The file is one request list, read by one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return numbered(parse(lines.withColumn("line", F.col("line") + 1)))


def problems(requests: DataFrame, meta: VolumeMeta, random: int = RANDOM_COUNT, continuous: int = CONTINUOUS_COUNT) -> DataFrame:
    """(axis, type, problem, n): what is wrong with a request set. Empty groups are fine; an empty set is not."""
    dims = F.create_map(*(x for a in AXES for x in (F.lit(a), F.lit(meta.size(a)))))
    step = F.col("index") - F.lag("index").over(Window.partitionBy("axis", "type").orderBy("seq"))
    rows = requests.withColumn("_step", step).withColumn("_out", (F.col("index") < 0) | (F.col("index") >= dims[F.col("axis")]))
    per = rows.groupBy("axis", "type").agg(
        F.count("*").alias("c"), F.count_if("_out").alias("out_of_bounds"), (F.count("*") - F.count_distinct("index")).alias("duplicates"), F.count_if(F.col("_step") != 1).alias("breaks")
    )
    want = F.when(F.col("type") == "random", random).otherwise(continuous)
    kinds = {
        "count": F.when(F.col("c") != want, F.col("c")),
        "out of bounds": F.col("out_of_bounds"),
        "duplicate": F.when(F.col("type") == "random", F.col("duplicates")),
        "not sequential": F.when(F.col("type") == "continuous", F.col("breaks")),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("problem"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for k, n in kinds.items())))
    found = per.select("axis", "type", each.alias("p")).select("axis", "type", "p.problem", "p.n").where("n > 0")
    none = requests.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("type"), F.lit("no requests").alias("problem"), F.lit(1).cast("long").alias("n"))
    return found.unionByName(none)


def fnv1a(data: bytes, state: int = FNV_BASIS) -> int:
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & ((1 << 64) - 1)
    return state


def fingerprint(groups: dict[str, list[int]]) -> int:
    """Hash of a request set: for each group its name, its length and its indices as little-endian 64 bits."""
    state = FNV_BASIS
    for kind in KINDS:
        for axis in AXES:
            name = f"{axis}_{kind}"
            own = groups.get(name, [])
            state = fnv1a(name.encode(), state)
            for n in (len(own), *own):
                state = fnv1a(n.to_bytes(8, "little"), state)
    return state


#: Basis of the hash that links a sidecar to its volume, one digit short of the usual one. Fixed value.
LINK_BASIS = 1469598103934665603


def link_hash(descriptors: list[int]) -> int:
    """Hash of record descriptors (16 bits, little endian), by which a copy names the volume it was made of."""
    return fnv1a(b"".join(d.to_bytes(2, "little") for d in descriptors), LINK_BASIS)


def generate(spark: SparkSession, meta: VolumeMeta, seed: int, random: int = RANDOM_COUNT, continuous: int = CONTINUOUS_COUNT) -> DataFrame:
    """A request set: random indices without repeats (in hash order) and a run at a hashed start, for each axis."""
    parts = []
    for axis in AXES:
        size = meta.size(axis)
        order = address.mixed("id", 3 * seed + AXES.index(axis))
        some = spark.range(size).orderBy(order, "id").limit(random).withColumn("seq", F.row_number().over(Window.orderBy(order, "id")) - 1)
        parts.append(some.select(F.lit(axis).alias("axis"), F.lit("random").alias("type"), F.col("seq").cast("int").alias("seq"), F.col("id").alias("index")))
        start = address.mod(address.mixed(F.lit(size), 3 * seed + AXES.index(axis)), max(1, size - continuous + 1))
        parts.append(spark.range(continuous).select(F.lit(axis).alias("axis"), F.lit("continuous").alias("type"), F.col("id").cast("int").alias("seq"), (start + F.col("id")).alias("index")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def slab_plan(requests: DataFrame, meta: VolumeMeta, thick: int = 4) -> DataFrame:
    """(axis, slab, slots): the slabs that requests (axis, type, seq, index) need, each once, with the requests it serves.

    A slot is a request's place among its axis's requests, by type and seq, and its index inside the slab. An index outside
    the volume, or an unknown axis, is an error.
    """
    ok = F.coalesce(address.inside(meta), F.lit(False))
    index = F.when(ok, F.col("index")).otherwise(F.raise_error(F.concat(F.col("axis"), F.lit(" index outside the volume"))).cast("long"))
    slot = (F.row_number().over(Window.partitionBy("axis").orderBy("type", "seq")) - 1).cast("long")
    rows = requests.select("axis", index.alias("i"), slot.alias("slot"))
    return rows.groupBy("axis", address.idiv("i", thick).alias("slab")).agg(F.sort_array(F.collect_list(F.struct("slot", address.mod("i", thick).alias("inside")))).alias("slots"))


def centred_run(size: int, count: int) -> list[int]:
    """A run of indices about the middle."""
    start = max(0, size // 2 - count // 2)
    return list(range(start, min(size, start + count)))
