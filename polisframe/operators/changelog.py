"""The change log: filtered reads, incremental windows, and regions of change."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.model import CityModel, ModelError, TypeRegistry
from polisframe.operators.outlines import outlines
from polisframe.operators.regions import cluster_boxes
from polisframe.operators.spatial_join import spatial_join
from polisframe.runtime import page_rows

TRANSACTION_TYPES = ("insert", "update", "terminate", "delete")


def change_condition(types: TypeRegistry | None = None, *, bbox: tuple[float, ...] | None = None,
                     bbox_mode: str = "intersects", feature_types: Iterable[str] = (),
                     transaction_types: Iterable[str] = (), after=None, until=None, objectids: Iterable[str] = (),
                     users: Iterable[str] = (), reasons: Iterable[str] = ()) -> Column:
    """The predicate on change rows, for batch and stream alike. Dates: after < date <= until. Classes are exact."""
    out = F.lit(True)
    if bbox is not None:
        box = env.box(*bbox)
        if bbox_mode == "intersects":
            out = out & env.intersects_2d("envelope", box)
        elif bbox_mode == "contains":
            # the change must contain the box
            out = out & env.contains(env.force_2d("envelope"), box)
        else:
            raise ModelError(f"unknown bbox mode {bbox_mode!r}")
    if feature_types:
        out = out & F.col("objectclass_id").isin([types.lookup(t)["id"] for t in feature_types])
    unknown = set(transaction_types) - set(TRANSACTION_TYPES)
    if unknown:
        raise ModelError(f"unknown transaction types {sorted(unknown)}")
    for column, values in (("transaction_type", transaction_types), ("objectid", objectids), ("db_user", users),
                           ("reason_for_update", reasons)):
        if list(values):
            out = out & F.col(column).isin(list(values))
    if after is not None:
        out = out & (F.col("transaction_date") > F.lit(after).cast("timestamp"))
    if until is not None:
        out = out & (F.col("transaction_date") <= F.lit(until).cast("timestamp"))
    return out


def changes(m: CityModel, *, sql: str | None = None, order: str | None = None, limit: int | None = None,
            **filters) -> DataFrame:
    """Change rows under all filters; ``order`` is ``latest_first`` or ``oldest_first`` (id breaks ties).

    ``sql`` is a one-column SELECT of change ids over the model's tables; ``limit`` stops early.
    """
    df = m.feature_changelog.where(change_condition(m.types if filters.get("feature_types") else None, **filters))
    if sql is not None:
        df = df.join(m.select_ids(sql), "id", "left_semi")
    if order not in (None, "latest_first", "oldest_first"):
        raise ModelError(f"unknown order {order!r}")
    date = F.col("transaction_date")
    keys = [date.desc() if order == "latest_first" else date.asc(), F.col("id")] if order else [F.col("id")]
    if limit is not None:
        return page_rows(df, keys, limit)
    return df.orderBy(*keys) if order else df


def change_clusters(m: CityModel, **filters) -> tuple[DataFrame, DataFrame]:
    """Members (id, cluster_id, region_id) and pieces of the regions; changes without an envelope are left out."""
    found = changes(m, **filters).where("envelope is not null")
    return cluster_boxes(found.select("id", "envelope.xmin", "envelope.ymin", "envelope.xmax", "envelope.ymax"))


def change_regions(m: CityModel, **filters) -> DataFrame:
    """One row per region (one polygon of the union of a cluster): cluster, changes, extent and exact area."""
    members, pieces = change_clusters(m, **filters)
    counts = members.groupBy("region_id").agg(F.min("cluster_id").alias("cluster_id"), F.count("*").alias("changes"))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    shape = pieces.groupBy("region_id").agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"), F.sum(area).alias("area"))
    return counts.join(shape, "region_id", "left")


def region_pieces(m: CityModel, **filters) -> DataFrame:
    """The regions as rectangles that do not overlap: (region_id, xmin, ymin, xmax, ymax)."""
    return change_clusters(m, **filters)[1]


def region_outlines(m: CityModel, **filters) -> DataFrame:
    """One polygon with its holes per region of change: (region_id, rings, holes, size, length)."""
    return outlines(change_clusters(m, **filters)[1], "region_id")


def changes_near(m: CityModel, features: DataFrame, distance: float = 0.0, **filters) -> DataFrame:
    """(feature_id, change_id): the changes whose boxes meet those of ``features`` (id, envelope) or are that near."""
    found = changes(m, **filters).select(F.col("id").alias("change_id"), F.col("envelope").alias("change_box"))
    pairs = spatial_join(features.select(F.col("id").alias("feature_id"), "envelope"), found, "envelope", "change_box", distance)
    return pairs.select("feature_id", "change_id")
