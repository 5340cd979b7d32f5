"""Load-time rewrites of a model: global appearances, shared geometries, template scope, LoD upgrades, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.model import RELATES, CityModel, ModelError
from polisframe.operators.hierarchy import closure, contains_edges
from polisframe.runtime import checkpointed, number_rows


def _next_id(df: DataFrame, column: str = "id") -> int:
    top = df.agg(F.max(column)).first()[0]
    return 1 if top is None else top + 1


def roots_of(m: CityModel, nodes: DataFrame) -> DataFrame:
    """(node_id, root_id): the top-level feature above each node (the least id, if it hangs below several)."""
    upward = contains_edges(m).select(F.col("child").alias("parent"), F.col("parent").alias("child"),
                                      F.lit(False).alias("is_boundary"))
    above = closure(upward, nodes).select(F.col("root_id").alias("node_id"), F.col("node_id").alias("root_id"))
    top = m.feature.where(F.col("objectclass_id").isin(m.types.feature_class_ids())).select(
        F.col("id").alias("root_id"))
    return above.join(top, "root_id", "left_semi").groupBy("node_id").agg(F.min("root_id").alias("root_id"))


def attach_global_appearances(m: CityModel, mode: str = "toplevel") -> CityModel:
    """Turn global appearances into local ones of the objects they paint.

    The owner of a painted geometry is its template, else its top-level feature (``toplevel``) or nearest feature
    (``child``). Each owner gets one copy of an appearance and of a surface data, with new ids; the mappings follow.
    Surface data without any target keep their global appearance.
    """
    if mode not in ("toplevel", "child"):
        raise ModelError(f"unknown appearance mode {mode!r}")
    global_ = m.appearance.where("feature_id is null and implicit_geometry_id is null")
    links = m.appear_to_surface_data.select("appearance_id", "surface_data_id").join(
        global_.select(F.col("id").alias("appearance_id")), "appearance_id", "left_semi")
    painted = m.surface_data_mapping.join(links, "surface_data_id")
    templates = m.implicit_geometry.where("relative_geometry_id is not null").select(
        F.col("relative_geometry_id").alias("geometry_data_id"), F.col("id").alias("template_id"))
    templates = templates.groupBy("geometry_data_id").agg(F.min("template_id").alias("template_id"))
    nearest = m.geometry_data.select(F.col("id").alias("geometry_data_id"), F.col("feature_id").alias("near_id"))
    painted = painted.join(templates, "geometry_data_id", "left").join(nearest, "geometry_data_id", "left")
    painted = checkpointed(painted)
    if mode == "toplevel":
        roots = roots_of(m, painted.where("template_id is null and near_id is not null").select("near_id"))
        painted = painted.join(roots.withColumnRenamed("node_id", "near_id"), "near_id", "left")
        owner = F.coalesce("root_id", "near_id")
    else:
        owner = F.col("near_id")
    painted = painted.withColumn("owner_id", F.when(F.col("template_id").isNull(), owner))
    painted = painted.where("owner_id is not null or template_id is not null")
    own = ["owner_id", "template_id"]
    key = lambda c: [F.col("owner_id").asc_nulls_last(), F.col("template_id"), F.col(c)]
    new_a = number_rows(painted.select(*own, "appearance_id").distinct(), key("appearance_id"), "new_appearance_id",
                        _next_id(m.appearance))
    new_s = number_rows(painted.select(*own, "appearance_id", "surface_data_id").distinct(), key("surface_data_id"),
                        "new_surface_data_id", _next_id(m.surface_data))

    def match(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        b = b.withColumnsRenamed({c: f"_{c}" for c in [*own, *more]})
        same = [a[c].eqNullSafe(b[f"_{c}"]) for c in own] + [a[c] == b[f"_{c}"] for c in more]
        return a.join(b, same).drop(*[f"_{c}" for c in [*own, *more]])

    appearance = new_a.join(global_.select(F.col("id").alias("appearance_id"), "theme"), "appearance_id").select(
        F.col("new_appearance_id").alias("id"), F.concat(F.lit("AP_local_"), F.col("new_appearance_id")).alias("objectid"),
        "theme", F.col("owner_id").alias("feature_id"), F.col("template_id").alias("implicit_geometry_id"))
    data_columns = [c for c in m.surface_data.columns if c not in ("id", "objectid")]
    data = new_s.join(m.surface_data.select(F.col("id").alias("surface_data_id"), *data_columns), "surface_data_id")
    data = data.select(F.col("new_surface_data_id").alias("id"), F.lit(None).cast("string").alias("objectid"),
                       *data_columns)
    linked = match(new_s, new_a, "appearance_id").select(
        (F.col("new_surface_data_id") + (_next_id(m.appear_to_surface_data) - _next_id(m.surface_data))).alias("id"),
        F.col("new_appearance_id").alias("appearance_id"), F.col("new_surface_data_id").alias("surface_data_id"))
    mapping = match(painted, new_s.drop("appearance_id"), "surface_data_id").drop("surface_data_id").withColumnRenamed(
        "new_surface_data_id", "surface_data_id").select(*m.surface_data_mapping.columns)
    done = painted.select("surface_data_id").distinct()
    keep_links = m.appear_to_surface_data.join(done, "surface_data_id", "left_anti")
    touched = painted.select(F.col("appearance_id").alias("id")).distinct()
    emptied = touched.join(keep_links.select(F.col("appearance_id").alias("id")), "id", "left_anti")
    gone = done.withColumnRenamed("surface_data_id", "id")
    return m.replace(
        appearance=m.appearance.join(emptied, "id", "left_anti").unionByName(appearance.select(*m.appearance.columns)),
        surface_data=m.surface_data.join(gone, "id", "left_anti").unionByName(data.select(*m.surface_data.columns)),
        appear_to_surface_data=keep_links.unionByName(linked),
        surface_data_mapping=m.surface_data_mapping.join(done, "surface_data_id", "left_anti").unionByName(mapping),
    )


def resolve_geometry_references(m: CityModel, relations: bool = False) -> CityModel:
    """Copy geometries used from another feature into the using feature.

    All uses inside one feature share one copy. With ``relations`` both features get a ``relatedTo`` property of type
    ``shared``, once per pair.
    """
    owners = m.geometry_data.select(F.col("id").alias("val_geometry_id"), F.col("feature_id").alias("owner_id"))
    used = m.property.where("val_geometry_id is not null")
    foreign = used.join(owners, "val_geometry_id").where("owner_id is not null and owner_id <> feature_id")
    foreign = checkpointed(foreign.select("id", "feature_id", "val_geometry_id", "owner_id"))
    pairs = foreign.select("feature_id", "val_geometry_id").distinct()
    copies = number_rows(pairs, [F.col("feature_id"), F.col("val_geometry_id")], "copy_id", _next_id(m.geometry_data))
    shapes = m.geometry_data.select(F.col("id").alias("val_geometry_id"), "geometry_type", "nodes", "primitives")
    copied = copies.join(shapes, "val_geometry_id").select(
        F.col("copy_id").alias("id"), "feature_id", "geometry_type", "nodes", "primitives")
    moved = foreign.select("id", "feature_id", "val_geometry_id").join(copies, ["feature_id", "val_geometry_id"]).select(
        "id", "copy_id")
    properties = m.property.join(moved, "id", "left").withColumn(
        "val_geometry_id", F.coalesce("copy_id", "val_geometry_id")).select(*m.property.columns)
    if relations:
        both = foreign.select("feature_id", F.col("owner_id").alias("val_feature_id"))
        both = both.unionByName(foreign.select(F.col("owner_id").alias("feature_id"),
                                               F.col("feature_id").alias("val_feature_id"))).distinct()
        rows = number_rows(both, [F.col("feature_id"), F.col("val_feature_id")], "id", _next_id(m.property))
        properties = properties.unionByName(_like(m.property, rows, name=F.lit("relatedTo"), namespace_id=F.lit(1),
                                                  val_string=F.lit("shared"), val_relation_type=F.lit(RELATES)))
    return m.replace(geometry_data=m.geometry_data.unionByName(copied), property=properties)


def _like(table: DataFrame, rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[
        (columns.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None))).cast(f.dataType).alias(f.name)
        for f in table.schema])


def resolve_cross_lod(m: CityModel, mode: str = "resolve") -> CityModel:
    """References between LoDs of one top-level feature.

    Of the properties of one tree that share a geometry, the first (by id) holds it. A later one of another LoD gets a
    copy (``resolve``; one copy per LoD), or is dropped if the holder is LoD 4 (``remove_lod4``).
    """
    if mode not in ("resolve", "remove_lod4"):
        raise ModelError(f"unknown cross-LoD mode {mode!r}")
    used = m.property.where("val_geometry_id is not null and val_lod is not null")
    shared = used.groupBy("val_geometry_id").agg(F.count("*").alias("n"), F.min(F.struct("id", "val_lod")).alias("h"))
    shared = shared.where("n > 1").select("val_geometry_id", F.col("h.id").alias("holder"),
                                          F.col("h.val_lod").alias("holder_lod"))
    uses = checkpointed(used.join(shared, "val_geometry_id").select(
        "id", "feature_id", "val_geometry_id", "val_lod", "holder", "holder_lod"))
    roots = roots_of(m, uses.select("feature_id"))
    uses = uses.join(roots.withColumnRenamed("node_id", "feature_id"), "feature_id", "left")
    holders = uses.where("id = holder").select("val_geometry_id", F.col("root_id").alias("holder_root"))
    crossing = uses.join(holders, "val_geometry_id").where(
        "root_id <=> holder_root and val_lod <> holder_lod and id <> holder")
    if mode == "remove_lod4":
        gone = crossing.where("holder_lod = '4'").select("id")
        return m.replace(property=m.property.join(gone, "id", "left_anti"))
    key = ["root_id", "val_geometry_id", "val_lod"]
    first = crossing.groupBy(*key).agg(F.min(F.struct("id", "feature_id")).alias("f"))
    copies = number_rows(first, [F.col(c) for c in key], "copy_id", _next_id(m.geometry_data))
    shapes = m.geometry_data.select(F.col("id").alias("val_geometry_id"), "geometry_type", "nodes", "primitives")
    copied = copies.join(shapes, "val_geometry_id").select(
        F.col("copy_id").alias("id"), F.col("f.feature_id").alias("feature_id"), "geometry_type", "nodes", "primitives")
    moved = crossing.select("id", *key).join(copies.select(*key, "copy_id"), key).select("id", "copy_id")
    properties = m.property.join(moved, "id", "left").withColumn(
        "val_geometry_id", F.coalesce("copy_id", "val_geometry_id")).select(*m.property.columns)
    return m.replace(geometry_data=m.geometry_data.unionByName(copied), property=properties)


def template_scope(m: CityModel, scope: str = "global") -> CityModel:
    """``global``: one template row per object id. ``top_level_feature``: one copy per top-level feature and template."""
    templates = m.implicit_geometry
    named = templates.where("objectid is not null")
    first = named.groupBy("objectid").agg(F.min("id").alias("keep_id"))
    to_first = named.join(first, "objectid").select(F.col("id").alias("val_implicitgeom_id"), "keep_id")
    used = m.property.where("val_implicitgeom_id is not null").select("id", "feature_id", "val_implicitgeom_id")
    used = used.join(to_first, "val_implicitgeom_id", "left").withColumn(
        "tid", F.coalesce("keep_id", "val_implicitgeom_id"))
    if scope == "global":
        moved = used.select("id", "tid")
        kept = templates.join(to_first.where("val_implicitgeom_id <> keep_id").select(
            F.col("val_implicitgeom_id").alias("id")), "id", "left_anti")
    elif scope == "top_level_feature":
        used = checkpointed(used.select("id", "feature_id", "tid"))
        roots = roots_of(m, used.select("feature_id")).withColumnRenamed("node_id", "feature_id")
        placed = used.join(roots, "feature_id", "left").withColumn("root_id", F.coalesce("root_id", "feature_id"))
        copies = number_rows(placed.select("root_id", "tid").distinct(), [F.col("root_id"), F.col("tid")], "copy_id",
                             _next_id(templates))
        moved = placed.join(copies, ["root_id", "tid"]).select("id", F.col("copy_id").alias("tid"))
        columns = [c for c in templates.columns if c != "id"]
        kept = copies.join(templates.select(F.col("id").alias("tid"), *columns), "tid").select(
            F.col("copy_id").alias("id"), *columns)
    else:
        raise ModelError(f"unknown template scope {scope!r}")
    moved = moved.where("tid is not null")
    properties = m.property.join(moved, "id", "left").withColumn(
        "val_implicitgeom_id", F.coalesce("tid", "val_implicitgeom_id")).select(*m.property.columns)
    return m.replace(implicit_geometry=kept.select(*templates.columns), property=properties)


def upgrade_lods(m: CityModel, roots: DataFrame) -> CityModel:
    """LoD 4 becomes LoD 3: in trees that have LoD 4, LoD 3 rows go first, then LoD 4 is relabelled."""
    tree = closure(contains_edges(m), roots).select("root_id", F.col("node_id").alias("feature_id"))
    four = m.property.where("val_lod = '4'").select("feature_id").distinct()
    having = tree.join(four, "feature_id").select("root_id").distinct()
    affected = tree.join(having, "root_id", "left_semi").select("feature_id").distinct()
    with_lod = m.property.where("val_lod in ('3', '4')").join(affected.withColumn("_hit", F.lit(True)), "feature_id",
                                                              "left")
    kept = with_lod.where("_hit is null or val_lod = '4'").withColumn(
        "val_lod", F.when(F.col("_hit"), "3").otherwise(F.col("val_lod")))
    other = m.property.where("val_lod is null or val_lod not in ('3', '4')")
    return m.replace(property=other.unionByName(kept.select(*m.property.columns)))


def upgrade_surfaces(m: CityModel, name: str, class_id: int, prefix: str) -> CityModel:
    """Move geometry properties called ``name`` into a new boundary sub-feature of a class, one per property.

    This is how a LoD 0 roof edge becomes a roof surface and a LoD 1 multi-surface a generic thematic surface.
    """
    moved = m.property.where((F.col("name") == name) & F.col("val_geometry_id").isNotNull())
    new = number_rows(moved, [F.col("id")], "new_id", _next_id(m.feature))
    owner = m.feature.select(F.col("id").alias("feature_id"), "envelope", "creation_date")
    features = _like(m.feature, new.join(owner, "feature_id"), id=F.col("new_id"), objectclass_id=F.lit(class_id),
                     objectid=F.concat(F.lit(prefix), F.col("new_id")))
    inner = _like(m.property, new, feature_id=F.col("new_id"), name=F.concat(F.lit("lod"), "val_lod", F.lit("MultiSurface")))
    start = _next_id(m.property)
    edge = _like(m.property, new.select(
        "feature_id", (F.col("new_id") - _next_id(m.feature) + start).alias("id"), "new_id"),
        name=F.lit("boundary"), namespace_id=F.lit(1), val_feature_id=F.col("new_id"), val_relation_type=F.lit(1))
    rest = m.property.join(moved.select("id"), "id", "left_anti").select(*m.property.columns)
    shapes = m.geometry_data.join(new.select(F.col("val_geometry_id").alias("id"), "new_id"), "id", "left").withColumn(
        "feature_id", F.coalesce("new_id", "feature_id")).select(*m.geometry_data.columns)
    return m.replace(feature=m.feature.unionByName(features), geometry_data=shapes,
                     property=rest.unionByName(inner).unionByName(edge))


def prune_group_members(m: CityModel, removed: DataFrame, group_ids: list[int], member: str = "groupMember",
                        parent: str = "parent") -> CityModel:
    """Groups lose members and parents among ``removed`` (ids); a group left without members goes too, and so on."""
    groups = m.feature.where(F.col("objectclass_id").isin(group_ids)).select("id")
    members = checkpointed(m.property.where(F.col("name") == member).select(
        F.col("feature_id").alias("group_id"), F.col("val_feature_id").alias("member_id")))
    had = members.select(F.col("group_id").alias("id")).distinct().join(groups, "id", "left_semi")
    gone = frontier = checkpointed(removed.select("id").distinct())
    while not frontier.isEmpty():
        left = members.join(gone.withColumnRenamed("id", "member_id"), "member_id", "left_anti")
        empty = had.join(left.select(F.col("group_id").alias("id")), "id", "left_anti")
        frontier = checkpointed(empty.join(gone, "id", "left_anti"))
        gone = gone.unionByName(frontier)
    dead = gone.withColumnRenamed("id", "val_feature_id")
    is_group_link = F.col("name").isin(member, parent)
    links = m.property.where(is_group_link).join(dead, "val_feature_id", "left_anti")
    rest = m.property.where(~is_group_link)
    rows = rest.unionByName(links.select(*m.property.columns)).join(
        gone.withColumnRenamed("id", "feature_id"), "feature_id", "left_anti").select(*m.property.columns)
    return m.replace(feature=m.feature.join(gone, "id", "left_anti"), property=rows)
