"""Deleting and terminating features. Both return a new model; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.functions.temporal import valid
from polisframe.model import CityModel
from polisframe.operators.hierarchy import contains_edges
from polisframe.runtime import checkpointed


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids reachable from ``start`` (its first column) over parent-child edges, the start included."""
    frontier = known = checkpointed(start.select(F.col(start.columns[0]).alias("id")).distinct())
    while True:
        found = frontier.join(edges, frontier["id"] == edges["parent"]).select(F.col("child").alias("id")).distinct()
        frontier = checkpointed(found.join(known, "id", "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def deletion_set(m: CityModel, ids: DataFrame) -> DataFrame:
    """The features that go with ``ids``: contained sub-trees, without what a surviving feature contains as well."""
    edges = checkpointed(contains_edges(m).select("parent", "child"))
    roots = ids.select("id").distinct()
    inside = reach(edges, roots)
    as_parent, as_child = inside.withColumnRenamed("id", "parent"), inside.withColumnRenamed("id", "child")
    own = edges.join(roots.withColumnRenamed("id", "child"), "child", "left_anti")
    held = own.join(as_child, "child", "left_semi").join(as_parent, "parent", "left_anti").select("child")
    survivors = reach(own, held)
    return checkpointed(inside.join(survivors, "id", "left_anti"))


def delete(m: CityModel, ids: DataFrame, preview: bool = False) -> tuple[CityModel, DataFrame]:
    """Remove features and all that hangs on them; returns the new model and the log of (table_name, id).

    With ``preview`` the model comes back unchanged beside the same log.
    """
    gone = deletion_set(m, ids)
    key = lambda name: gone.withColumnRenamed("id", name)
    properties = m.property.join(key("feature_id"), "feature_id", "left_anti")
    # references from surviving features to deleted ones go too; rows without a reference skip the join
    pointing = properties.where("val_feature_id is not null").join(key("val_feature_id"), "val_feature_id", "left_anti")
    properties = properties.where("val_feature_id is null").unionByName(pointing)
    dead_appearances = m.appearance.join(key("feature_id"), "feature_id", "left_semi").select("id")
    links = m.appear_to_surface_data
    dead_links = links.join(dead_appearances.withColumnRenamed("id", "appearance_id"), "appearance_id", "left_semi")
    live_links = links.join(dead_appearances.withColumnRenamed("id", "appearance_id"), "appearance_id", "left_anti")
    dead_data = dead_links.select(F.col("surface_data_id").alias("id")).distinct().join(
        live_links.select(F.col("surface_data_id").alias("id")), "id", "left_anti")
    used = lambda rows: rows.where("val_address_id is not null").select(F.col("val_address_id").alias("id"))
    dead_addresses = used(m.property.join(key("feature_id"), "feature_id", "left_semi")).distinct().join(
        used(properties), "id", "left_anti")
    dead_geometries = m.geometry_data.join(key("feature_id"), "feature_id", "left_semi").select("id")
    log = _log(feature=gone, geometry_data=dead_geometries, appearance=dead_appearances, surface_data=dead_data,
               address=dead_addresses)
    if preview:
        return m, log
    mapping = m.surface_data_mapping.join(
        dead_data.withColumnRenamed("id", "surface_data_id"), "surface_data_id", "left_anti").join(
        dead_geometries.withColumnRenamed("id", "geometry_data_id"), "geometry_data_id", "left_anti")
    return m.replace(
        feature=m.feature.join(gone, "id", "left_anti"),
        property=properties.select(*m.property.columns),
        geometry_data=m.geometry_data.join(dead_geometries, "id", "left_anti"),
        appearance=m.appearance.join(dead_appearances, "id", "left_anti"),
        appear_to_surface_data=live_links.select(*links.columns),
        surface_data=m.surface_data.join(dead_data, "id", "left_anti"),
        surface_data_mapping=mapping.select(*m.surface_data_mapping.columns),
        address=m.address.join(dead_addresses, "id", "left_anti"),
    ), log


def terminate(m: CityModel, ids: DataFrame, now: Column, sub_features: bool = True, termination_date: Column | None = None,
              reason: str | None = None, lineage: str | None = None, person: str | None = None,
              preview: bool = False) -> tuple[CityModel, DataFrame]:
    """Set the termination date (given, or ``now``) of features that have none, and of their sub-features.

    ``now`` is also the last modification date; reason, lineage and person overwrite only if given.
    """
    if sub_features:
        targets = reach(contains_edges(m).select("parent", "child").distinct(), ids.select("id"))
    else:
        targets = ids.select("id").distinct()
    targets = m.feature.where(valid()).select("id").join(targets, "id", "left_semi")
    log = _log(feature=targets)
    if preview:
        return m, log
    end = termination_date if termination_date is not None else now
    marked = m.feature.join(targets.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    changes = {"termination_date": end.cast("timestamp"), "last_modification_date": now.cast("timestamp"),
               "reason_for_update": reason, "lineage": lineage, "updating_person": person}
    for name, value in changes.items():
        if value is not None:
            value = value if isinstance(value, Column) else F.lit(value)
            marked = marked.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return m.replace(feature=marked.select(*m.feature.columns)), log


def remove(m: CityModel, features: DataFrame, now: Column, mode: str = "terminate", **options):
    """Entry point with the defaults of a removal job: terminate, and only what is still valid."""
    valid_ids = m.feature.where(valid()).join(features.select("id"), "id", "left_semi").select("id")
    if mode == "terminate":
        return terminate(m, valid_ids, now, **options)
    return delete(m, valid_ids, **options)


def _log(**tables: DataFrame) -> DataFrame:
    out = None
    for name, ids in tables.items():
        rows = ids.select(F.lit(name).alias("table_name"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out
