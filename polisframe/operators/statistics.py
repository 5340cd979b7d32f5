"""Content statistics. Scope: ``all``; ``active`` = not terminated features; ``terminated`` = the others.

Every statistic is one aggregate with map-side partial sums; class ids stay ids unless names are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.model import SCHEMAS, CityModel, ModelError
from polisframe.runtime import local_frame

NO_THEME = "<none>"


def _in_scope(scope: str) -> Column | None:
    if scope == "all":
        return None
    if scope == "active":
        return F.col("termination_date").isNull()
    if scope == "terminated":
        return F.col("termination_date").isNotNull()
    raise ModelError(f"unknown scope {scope!r}")


def _features(m: CityModel, scope: str) -> DataFrame:
    condition = _in_scope(scope)
    return m.feature if condition is None else m.feature.where(condition)


def _of_features(m: CityModel, rows: DataFrame, scope: str, key: str = "feature_id") -> DataFrame:
    """Rows that belong to a feature in scope; every row when the scope is ``all``."""
    if scope == "all":
        return rows
    owners = _features(m, scope).select(F.col("id").alias(key))
    return rows.join(owners, key, "left_semi")


def _or_ownerless(m: CityModel, rows: DataFrame, scope: str) -> DataFrame:
    """Scope by a left join: a row without a feature has no termination date, so it counts as active."""
    if scope == "all":
        return rows
    other = "terminated" if scope == "active" else "active"
    if scope == "terminated":
        return _of_features(m, rows, scope)
    return rows.join(_features(m, other).select(F.col("id").alias("feature_id")), "feature_id", "left_anti")


def feature_count(m: CityModel, scope: str = "all") -> DataFrame:
    return _features(m, scope).groupBy("objectclass_id").agg(F.count("*").alias("n"))


def feature_count_and_extent(m: CityModel, scope: str = "all") -> DataFrame:
    return _features(m, scope).groupBy("objectclass_id").agg(
        F.count("*").alias("n"), env.extent("envelope").alias("envelope"))


def feature_count_by_lod(m: CityModel, scope: str = "all") -> DataFrame:
    """Counts property rows that carry the LoD, not distinct features."""
    rows = _of_features(m, m.property.where("val_lod is not null"), scope)
    return rows.groupBy("val_lod").agg(F.count("feature_id").alias("n"))


def geometry_count_by_lod(m: CityModel, scope: str = "all") -> DataFrame:
    rows = _of_features(m, m.property.where("val_lod is not null"), scope)
    return rows.groupBy("val_lod").agg(F.count("val_geometry_id").alias("n"))


def geometry_count(m: CityModel, scope: str = "all") -> DataFrame:
    return _or_ownerless(m, m.geometry_data, scope).groupBy("geometry_type").agg(F.count("*").alias("n"))


def implicit_geometry_count(m: CityModel) -> DataFrame:
    return m.implicit_geometry.agg(F.count("*").alias("n"))


def lods(m: CityModel, scope: str = "all") -> DataFrame:
    return _of_features(m, m.property.where("val_lod is not null"), scope).select("val_lod").distinct()


def appearance_count_by_theme(m: CityModel, scope: str = "all") -> DataFrame:
    rows = _or_ownerless(m, m.appearance, scope)
    return rows.groupBy(F.coalesce("theme", F.lit(NO_THEME)).alias("theme")).agg(F.count("*").alias("n"))


def themes(m: CityModel, scope: str = "all") -> DataFrame:
    return _or_ownerless(m, m.appearance, scope).select(
        F.coalesce("theme", F.lit(NO_THEME)).alias("theme")).distinct()


def _scoped_mappings(m: CityModel, scope: str) -> DataFrame:
    if scope == "all":
        return m.surface_data_mapping
    geometries = _or_ownerless(m, m.geometry_data, scope).select(F.col("id").alias("geometry_data_id"))
    return m.surface_data_mapping.join(geometries, "geometry_data_id", "left_semi")


def surface_data_flags(m: CityModel, scope: str = "all") -> DataFrame:
    """Whether any material, texture or georeferenced texture is mapped to a surface; one row."""
    has = lambda *names: F.coalesce(
        F.max(F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in names])), F.lit(False))
    return _scoped_mappings(m, scope).agg(
        has("material_mapping").alias("has_materials"),
        has("texture_mapping", "world_to_texture_mapping").alias("has_textures"),
        has("georeferenced_texture_mapping").alias("has_georeferenced"))


def surface_data_count(m: CityModel, scope: str = "all") -> DataFrame:
    rows = m.surface_data
    if scope != "all":
        used = _scoped_mappings(m, scope).select(F.col("surface_data_id").alias("id"))
        rows = rows.join(used, "id", "left_semi")
    return rows.groupBy("objectclass_id").agg(F.count("id").alias("n"))


def has_global_appearances(m: CityModel) -> DataFrame:
    found = m.appearance.where("feature_id is null and implicit_geometry_id is null").limit(1)
    return found.agg((F.count("*") > 0).alias("has_global"))


def generic_attributes(m: CityModel, scope: str = "all") -> DataFrame:
    """Distinct (class, name, data type) in the generics namespace, without what a generic class itself declares."""
    generics = m.types.namespaces["gen"]
    rows = m.property.where(F.col("namespace_id") == generics).select("feature_id", "name", "datatype_id")
    owners = _features(m, scope).select(F.col("id").alias("feature_id"), "objectclass_id")
    found = rows.join(owners, "feature_id").select("objectclass_id", "name", "datatype_id").distinct()
    declared = [(c["id"], p.name) for c in m.types.classes.values() if c["namespace_id"] == generics
                for p in m.types._declared(c).values()]
    if not declared:
        return found
    known = local_frame(m.spark, declared, "objectclass_id int, name string")
    return found.join(known, ["objectclass_id", "name"], "left_anti")


def address_count(m: CityModel, scope: str = "all") -> DataFrame:
    rows = m.address
    if scope != "all":
        used = _of_features(m, m.property.where("val_address_id is not null"), scope)
        rows = rows.join(used.select(F.col("val_address_id").alias("id")), "id", "left_semi")
    return rows.agg(F.count("id").alias("n"))


def extension_list(m: CityModel) -> DataFrame:
    return m.ade.select("name", "description", "version")


def codelist_summary(m: CityModel) -> DataFrame:
    """One row per code list type and distinct url."""
    return m.codelist.select("codelist_type", "url").distinct()


def distinct_lods_per_feature(m: CityModel) -> DataFrame:
    return m.property.groupBy("feature_id").agg(F.count_distinct("val_lod").alias("lods"))


def table_sizes(m: CityModel) -> DataFrame:
    """Row count per table."""
    parts = [m.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in SCHEMAS if n in m.tables]
    return _stack(parts)


def type_summary(m: CityModel, objects: DataFrame) -> DataFrame:
    """Count per class of any frame with ``objectclass_id``, named ``alias:Name`` and sorted by it."""
    names = m.objectclass.join(m.namespace.select(F.col("id").alias("namespace_id"), "alias"), "namespace_id").select(
        F.col("id").alias("objectclass_id"), F.concat_ws(":", "alias", "classname").alias("type_name"))
    counts = objects.groupBy("objectclass_id").agg(F.count("*").alias("n"))
    return counts.join(names, "objectclass_id").select("type_name", "n").orderBy("type_name")


def model_report(m: CityModel, scope: str = "active", compact: bool = False, generic: bool = False,
                 sizes: bool = False) -> DataFrame:
    """All statistics as rows (section, key, value). ``active`` means ``all`` if nothing is terminated."""
    if scope == "active" and m.feature.where("termination_date is not null").isEmpty():
        scope = "all"
    names = m.objectclass.select(F.col("id").alias("objectclass_id"), "classname")

    def rows(section: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                         value.cast("bigint").alias("value"))

    def by_class(section, df):
        return rows(section, df.join(names, "objectclass_id"), F.col("classname"), F.col("n"))

    one, n = F.lit(1), F.col("n")
    parts = [by_class("terminated_features", feature_count(m, "terminated")),
             by_class("active_features", feature_count(m, "active"))]
    if compact:
        parts += [rows("lods", lods(m, scope), F.col("val_lod"), one),
                  rows("appearances", themes(m, scope), F.col("theme"), one)]
    else:
        flags = surface_data_flags(m, scope)
        parts += [
            rows("geometries", geometry_count(m, scope), F.col("geometry_type"), n),
            rows("implicit_geometries", implicit_geometry_count(m), F.lit("count"), n),
            rows("lods", geometry_count_by_lod(m, scope), F.col("val_lod"), n),
            rows("appearances", appearance_count_by_theme(m, scope), F.col("theme"), n),
            rows("surface_data", flags.select(F.expr(
                "stack(3, 'materials', has_materials, 'textures', has_textures, 'georeferenced', has_georeferenced)"
                " as (kind, present)")), F.col("kind"), F.col("present").cast("int")),
            rows("global_appearances", has_global_appearances(m), F.lit("present"), F.col("has_global").cast("int")),
            rows("addresses", address_count(m, scope), F.lit("count"), n),
            rows("extensions", extension_list(m), F.concat_ws(" ", "name", "version"), one),
            rows("codelists", codelist_summary(m), F.concat_ws(" ", "codelist_type", "url"), one),
        ]
    if generic:
        parts.append(rows("generic_attributes", generic_attributes(m, scope).join(names, "objectclass_id"),
                          F.concat_ws(".", "classname", "name"), F.col("datatype_id")))
    if sizes:
        parts.append(rows("table_sizes", table_sizes(m), F.col("table_name"), n))
    return _stack(parts)


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
