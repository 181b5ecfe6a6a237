"""Replicas of a volume, stored for other axes or for every n-th plane, and the routing of requests to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address
from ..meta import AXES
from .volume import Volume


@dataclass(frozen=True)
class Replica:
    """Planes 0, stride, 2 stride, ... of an axis, as a volume of their own (coordinates unchanged)."""

    axis: str
    volume: Volume
    stride: int = 1
    within_block: bool = False

    def has(self, index="index"):
        """Does the replica have the plane? With ``within_block`` strides count from each superblock's start."""
        if self.within_block:
            size = self.volume.meta.super_block[AXES.index(self.axis)]
            return address.mod(address.mod(index, size), self.stride) == 0
        return address.on_stride(index, self.stride)


def planes(volume: Volume, axis: str, stride: int = 1) -> DataFrame:
    """Cells of every stride-th plane of an axis: what a replica stores."""
    return volume.cells().where(address.on_stride(axis, max(stride, 1)))


def route(requests: DataFrame, replicas: list[Replica]) -> DataFrame:
    """The requests with the number of the first replica that has the plane, or -1 for the base table."""
    way = F.lit(-1)
    for k, r in reversed(list(enumerate(replicas))):
        way = F.when((F.col("axis") == r.axis) & r.has("index"), F.lit(k)).otherwise(way)
    return requests.withColumn("replica", way)


def batch(base: Volume, replicas: list[Replica], requests: DataFrame) -> DataFrame:
    """A batch of slices, each from the first replica that has it, the rest from the base table."""
    routed = route(requests, replicas)
    out = base.batch(routed.where("replica = -1").drop("replica")).withColumn("replica", F.lit(-1))
    for k, r in enumerate(replicas):
        out = out.unionByName(r.volume.batch(routed.where(F.col("replica") == k).drop("replica")).withColumn("replica", F.lit(k)))
    return out


def usable(replica: DataFrame | None, axis: str) -> bool:
    """Has the replica the columns it should have? One that has not is passed over, and the base table read."""
    return replica is not None and {"x", "y", "z", "v"} <= set(replica.columns) and axis in AXES


def storage_ratio(base_bytes: int, replica_bytes: list[int], raw_bytes: int) -> float:
    return (base_bytes + sum(replica_bytes)) / raw_bytes


def may_append(raw_bytes: int, total_bytes: int, force: bool = False) -> bool:
    """May a raw X replica be added? Volumes of 10 MiB and more are held to a ratio of 1.495, or 1.5 by force."""
    return raw_bytes < 10 << 20 or total_bytes / raw_bytes <= (1.5 if force else 1.495)
