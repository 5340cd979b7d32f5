"""Containment trees: closure, LoD search, template usage, validity pruning, assembly and post-processing.

The closure is a breadth-first loop over (root, node) pairs. Each round joins the last frontier with the containment
edges, takes the least depth per pair and drops pairs already known, so cycles and shared sub-features end on their
own. Rounds are written to the shared folder; their number is the depth of the data, not its size.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions import geometry as geo
from polisframe.functions.temporal import validity
from polisframe.model import CONTAINS, CityModel, ModelError
from polisframe.runtime import checkpointed


def contains_edges(m: CityModel) -> DataFrame:
    """parent, child, property id, and whether the edge is a core boundary."""
    return m.property.where(f"val_relation_type = {CONTAINS} and val_feature_id is not null").select(
        F.col("feature_id").alias("parent"), F.col("val_feature_id").alias("child"), F.col("id").alias("property_id"),
        ((F.col("namespace_id") == 1) & (F.col("name") == "boundary")).alias("is_boundary"))


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, free_boundaries: bool = False,
            reuse_edges: bool = True) -> DataFrame:
    """(root_id, node_id, depth): everything contained in each root, itself at depth 0, with its least depth.

    ``free_boundaries`` makes boundary edges cost no depth. ``roots`` is a frame whose first column is the root id.
    """
    cost = F.when(F.col("is_boundary"), 0).otherwise(1) if free_boundaries else F.lit(1)
    edges = edges.select("parent", "child", cost.alias("cost"))
    if reuse_edges:
        edges = checkpointed(edges)
    first = F.col(roots.columns[0])
    frontier = roots.select(first.alias("root_id"), first.alias("node_id"), F.lit(0).alias("depth")).distinct()
    frontier = known = checkpointed(frontier)
    while True:
        found = frontier.join(edges, frontier["node_id"] == edges["parent"]).select(
            "root_id", F.col("child").alias("node_id"), (F.col("depth") + F.col("cost")).alias("depth"))
        if max_depth is not None:
            found = found.where(F.col("depth") <= max_depth)
        found = found.groupBy("root_id", "node_id").agg(F.min("depth").alias("depth"))
        keys = ["root_id", "node_id"]
        if free_boundaries:
            before = known.groupBy(*keys).agg(F.min("depth").alias("known_depth"))
            found = found.join(before, keys, "left").where("known_depth is null or depth < known_depth").drop(
                "known_depth")
        else:
            found = found.join(known, keys, "left_anti")
        frontier = checkpointed(found)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    if free_boundaries:
        known = known.groupBy("root_id", "node_id").agg(F.min("depth").alias("depth"))
    return known


def feature_hierarchy(m: CityModel, roots: DataFrame) -> DataFrame:
    """All property rows reachable over contains edges, with the root they belong to and their feature's depth."""
    nodes = closure(contains_edges(m), roots)
    return nodes.join(m.property, nodes["node_id"] == m.property["feature_id"]).drop("node_id")


def lod_filter(m: CityModel, features: DataFrame, lods: Iterable[str] | None = None, mode: str = "or",
               depth: int | None = 0) -> DataFrame:
    """Features that have any (``or``) or all (``and``) of the LoDs within ``depth`` containment levels.

    Boundary edges cost no level, no LoD list means any LoD, and depth ``None`` searches the whole tree.
    """
    lods = list(dict.fromkeys(lods or []))
    if mode not in ("or", "and"):
        raise ModelError(f"unknown LoD mode {mode!r}")
    with_lod = m.property.where(F.col("val_lod").isin(lods) if lods else F.col("val_lod").isNotNull())
    # few distinct LoDs per feature: reduce before meeting the tree
    with_lod = with_lod.select(F.col("feature_id").alias("node_id"), "val_lod").distinct()
    nodes = closure(contains_edges(m), features.select("id"), depth, free_boundaries=True)
    hits = nodes.join(with_lod, "node_id")
    if mode == "and" and len(lods) > 1:
        counts = hits.groupBy("root_id").agg(F.count_distinct("val_lod").alias("found"))
        hits = counts.where(F.col("found") == len(lods))
    return features.join(hits.select(F.col("root_id").alias("id")), "id", "left_semi")


def template_usage(m: CityModel, features: DataFrame) -> DataFrame:
    """Distinct (template id, LoD) reachable from the features."""
    nodes = closure(contains_edges(m), features.select("id")).select("node_id").distinct()
    used = m.property.where("val_implicitgeom_id is not null")
    return used.join(nodes, used["feature_id"] == nodes["node_id"], "left_semi").select(
        F.col("val_implicitgeom_id").alias("id"), F.col("val_lod").alias("lod")).distinct()


def prune_invalid(m: CityModel, roots: DataFrame, mode: str = "valid", at=None, reference: str = "database",
                  lenient: bool = False) -> DataFrame:
    """The closure without invalid sub-features; the roots themselves are exempt.

    What an invalid feature contains stays only if a surviving feature contains it too.
    """
    condition = validity(mode, at, reference, lenient)
    edges = contains_edges(m)
    if condition is not None:
        good = m.feature.where(condition).select(F.col("id").alias("child"))
        edges = edges.join(good, "child", "left_semi")
    return closure(edges, roots)


# -- lookups by id

def properties_of(m: CityModel, ids: DataFrame) -> DataFrame:
    """Property rows of the features, with namespace alias and data type name."""
    names = m.namespace.select(F.col("id").alias("namespace_id"), F.col("alias").alias("namespace"))
    types = m.datatype.select(F.col("id").alias("datatype_id"), F.col("typename").alias("datatype"))
    rows = m.property.join(ids.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    return rows.join(names, "namespace_id", "left").join(types, "datatype_id", "left")


def features_of(m: CityModel, ids: DataFrame) -> DataFrame:
    return m.feature.join(ids.select("id"), "id", "left_semi")


def geometries_of(m: CityModel, ids: DataFrame) -> DataFrame:
    """Geometries (world or template) by geometry id."""
    return m.geometry_data.join(ids.select("id"), "id", "left_semi")


def templates_of(m: CityModel, ids: DataFrame) -> DataFrame:
    """Templates with their geometry, or only a library file."""
    wanted = m.implicit_geometry.join(ids.select("id"), "id", "left_semi")
    g = m.geometry_data.select(F.col("id").alias("relative_geometry_id"), "geometry_type", "nodes", "primitives")
    return wanted.join(g, "relative_geometry_id", "left")


def template_appearances(m: CityModel, ids: DataFrame) -> DataFrame:
    return m.appearance.join(ids.select(F.col("id").alias("implicit_geometry_id")), "implicit_geometry_id", "left_semi")


def appearances_of(m: CityModel, ids: DataFrame, themes: Iterable[str | None] | None = None) -> DataFrame:
    """Appearances of features and the templates given in ``ids`` (column ``id``, and optionally ``template_id``),
    with surface data, texture image and mapping. ``None`` among the themes selects the null theme."""
    rows = m.appearance.join(ids.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    if "template_id" in ids.columns:
        templates = ids.where("template_id is not null").select(F.col("template_id").alias("id"))
        rows = rows.unionByName(template_appearances(m, templates))
    if themes is not None:
        named = [t for t in themes if t is not None]
        accepted = F.col("theme").isin(named) if named else F.lit(False)
        if None in list(themes):
            accepted = accepted | F.col("theme").eqNullSafe(F.lit(None))
        rows = rows.where(accepted)
    link = m.appear_to_surface_data.select(F.col("appearance_id").alias("id"), "surface_data_id")
    data = m.surface_data.select(
        F.col("id").alias("surface_data_id"), F.col("objectid").alias("surface_data_objectid"),
        F.col("objectclass_id").alias("surface_data_class_id"), "tex_image_id")
    image = m.tex_image.select(F.col("id").alias("tex_image_id"), "image_uri")
    return (rows.join(link, "id").join(data, "surface_data_id").join(image, "tex_image_id", "left")
            .join(m.surface_data_mapping, "surface_data_id", "left"))


def addresses_of(m: CityModel, ids: DataFrame) -> DataFrame:
    """Addresses that a property of the features refers to, once per feature."""
    used = m.property.where("val_address_id is not null").join(
        ids.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    links = used.select("feature_id", F.col("val_address_id").alias("id")).distinct()
    return links.join(m.address, "id")


# -- assembly

def assemble(m: CityModel, roots: DataFrame) -> DataFrame:
    """The feature trees as rows: one per property of every contained feature, with root, depth and parent.

    ``parent_id`` nests attributes inside attributes; a relates edge stays a reference and is not followed. Sorted
    output orders by (root_id, depth, feature_id, name, id). A second occurrence of an object id inside one root is
    marked ``is_reference``.
    """
    nodes = closure(contains_edges(m), roots)
    features = m.feature.select(F.col("id").alias("node_id"), "objectclass_id", "objectid")
    tree = nodes.join(features, "node_id")
    # least (depth, node) per object id and root: an aggregate, so that a large root is no single window group
    first = tree.groupBy("root_id", "objectid").agg(F.min(F.struct("depth", "node_id")).alias("first"))
    tree = tree.join(first, ["root_id", "objectid"]).withColumn(
        "is_reference", F.col("node_id") != F.col("first.node_id")).drop("first")
    columns = [c for c in m.property.columns if c != "feature_id"]
    rows = m.property.select(F.col("feature_id").alias("node_id"), *columns)
    return tree.join(rows, "node_id", "left").withColumnRenamed("node_id", "feature_id")


def property_value() -> Column:
    """The value of a property row as VARIANT, null if it has none of its own."""
    plain = ("val_int", "val_double", "val_string", "val_timestamp", "val_uri", "val_geometry_id", "val_implicitgeom_id", "val_address_id")
    return F.coalesce(*[F.col(c).cast("variant") for c in plain])


def unfolded(m: CityModel, roots: DataFrame, valued: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The items of all trees, level by level: features, their properties, and what those hold. ``valued`` adds ``value`` to property rows.

    Item: (root_id, kind, key, parent_kind, parent_key, name, class, objectid, lod, reference, value). A feature is an item where it comes first:
    on the least level of its root, there under the least property; any other property that holds it refers to it.
    """
    inside = closure(contains_edges(m), roots).select(F.col("node_id")).distinct()
    classes = m.objectclass.select(F.col("id").alias("objectclass_id"), F.col("classname").alias("class"))
    features = checkpointed(m.feature.join(inside, m.feature["id"] == inside["node_id"], "left_semi").select(
        F.col("id").alias("key"), "objectclass_id", "objectid").join(classes, "objectclass_id", "left").drop("objectclass_id"))
    own = valued(m.property.join(inside.select(F.col("node_id").alias("feature_id")), "feature_id", "left_semi"))
    kind = own.schema["value"].dataType
    own = own.select(F.col("id").alias("key"), "feature_id", "parent_id", "name", F.col("val_lod").alias("lod"), "val_feature_id", "val_relation_type", "value")
    own = checkpointed(own)
    named = own.where("val_feature_id is not null").select("val_feature_id").distinct()
    targets = m.feature.select(F.col("id").alias("val_feature_id"), F.col("objectid").alias("target")).join(named, "val_feature_id", "left_semi")
    properties = checkpointed(own.join(targets, "val_feature_id", "left"))
    held = properties["val_feature_id"].isNotNull() & (properties["val_relation_type"] == CONTAINS)
    first = roots.select(F.col(roots.columns[0]).alias("root_id"), F.col(roots.columns[0]).alias("key")).distinct()
    nothing = F.lit(None)
    now = checkpointed(first.join(features, "key").select(
        "root_id", F.lit("f").alias("kind"), "key", nothing.cast("string").alias("parent_kind"), nothing.cast("bigint").alias("parent_key"),
        nothing.cast("string").alias("name"), "class", "objectid", nothing.cast("string").alias("lod"), nothing.cast("bigint").alias("child"), nothing.cast("string").alias("target"),
        nothing.cast(kind).alias("value")))
    columns, levels = now.columns, []
    seen = now.select("root_id", "objectid")
    while not levels or not now.isEmpty():
        levels.append(now)
        above = now.select("root_id", F.col("kind").alias("parent_kind"), F.col("key").alias("parent_key"))
        member = properties.withColumns({"parent_kind": F.when(F.col("parent_id").isNull(), "f").otherwise("p"), "parent_key": F.coalesce("parent_id", "feature_id")})
        below = member.join(above, ["parent_kind", "parent_key"]).withColumns({
            "kind": F.lit("p"), "class": nothing.cast("string"), "objectid": nothing.cast("string"), "child": F.when(held, F.col("val_feature_id"))}).select(*columns)
        holders = now.where("child is not null").select("root_id", F.col("key").alias("parent_key"), "child")
        new = holders.join(features.withColumnRenamed("key", "child"), "child").join(seen, ["root_id", "objectid"], "left_anti")
        chosen = new.groupBy("root_id", "objectid").agg(F.min(F.struct("parent_key", "child", "class")).alias("c")).select(
            "root_id", F.lit("f").alias("kind"), F.col("c.child").alias("key"), F.lit("p").alias("parent_kind"), "c.parent_key", nothing.cast("string").alias("name"), "c.class",
            "objectid", nothing.cast("string").alias("lod"), nothing.cast("bigint").alias("child"), nothing.cast("string").alias("target"), nothing.cast(kind).alias("value"))
        now = checkpointed(below.unionByName(chosen))
        seen = seen.unionByName(now.where("kind = 'f'").select("root_id", "objectid"))
    return levels


def sort_properties(column: str, nulls_last: bool = False) -> Column:
    """An array of (name, key, item) structs as its items, same-named ones in id order; null names and ids only have a place with ``nulls_last``."""
    before = lambda x, y: F.when((x["name"] < y["name"]) | ((x["name"] == y["name"]) & (x["key"] < y["key"])), -1).otherwise(1)
    if nulls_last:
        order = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(a.isNull().cast("int") - b.isNull().cast("int"))
        before = lambda x, y: F.when(x["name"].eqNullSafe(y["name"]), order(x["key"], y["key"])).otherwise(order(x["name"], y["name"]))
    return F.transform(F.array_sort(F.col(column), before), lambda x: x["item"])


def sorted_properties(rows: DataFrame) -> DataFrame:
    """(feature_id, id, name, pos): the place of every property row among those of its feature, by name and id, nulls last."""
    listed = rows.groupBy("feature_id").agg(F.collect_list(F.struct("name", F.col("id").alias("key"), F.struct("id", "name").alias("item"))).alias("unsorted"))
    placed = listed.select("feature_id", F.posexplode(sort_properties("unsorted", nulls_last=True)).alias("pos", "p"))
    return placed.select("feature_id", "p.id", "p.name", (F.col("pos") + 1).alias("pos"))


def nested(m: CityModel, roots: DataFrame, value: Column | None = None) -> DataFrame:
    """(root_id, tree): each root with all it contains as one VARIANT, whatever its size.

    A feature is {class, id, objectid, properties}, a property {children, feature, id, lod, name, reference, value}: ``children`` are the attributes
    inside it, ``feature`` is what it contains, ``reference`` the objectid of a feature that stands elsewhere. ``value`` is a VARIANT of a property
    row, by default its own value. Trees are folded from the deepest level up; a level meets the one above it in one join.
    """
    own = property_value() if value is None else value
    elsewhere = F.when(F.col("feature").isNull(), F.col("target"))
    as_property = F.to_variant_object(F.struct(F.col("members").alias("children"), "feature", F.col("key").alias("id"), "lod", "name", elsewhere.alias("reference"), "value"))
    as_feature = F.to_variant_object(F.struct("class", F.col("key").alias("id"), "objectid", F.col("members").alias("properties")))
    return folded(unfolded(m, roots, lambda rows: rows.withColumn("value", own)), as_property, as_feature, "variant")


def folded(levels: list[DataFrame], as_property: Column, as_feature: Column, kind: str) -> DataFrame:
    """(root_id, tree): the items of ``unfolded`` put into each other from the deepest level up.

    The two columns make the item of a property and of a feature, of type ``kind``, from its own columns, ``members`` (the items of the
    properties in it, in order) and ``feature`` (the item of the feature that it contains).
    """
    empty = F.array().cast(f"array<{kind}>")
    kids = None
    for level in reversed(levels):
        if kids is None:
            level = level.withColumns({"members": empty, "feature": F.lit(None).cast(kind)})
        else:
            level = level.join(kids, ["root_id", "kind", "key"], "left").withColumn("members", F.coalesce("members", empty))
        made = level.select("root_id", "kind", "parent_kind", "parent_key", "name", "key", F.when(F.col("kind") == "p", as_property).otherwise(as_feature).alias("item"))
        inner = F.when(F.col("kind") == "p", F.struct("name", "key", "item"))
        kids = made.groupBy("root_id", F.col("parent_kind").alias("kind"), F.col("parent_key").alias("key")).agg(
            F.collect_list(inner).alias("unsorted"), F.first(F.when(F.col("kind") == "f", F.col("item")), ignorenulls=True).alias("feature"))
        kids = kids.select("root_id", "kind", "key", sort_properties("unsorted").alias("members"), "feature")
    return kids.select("root_id", F.col("feature").alias("tree"))


# -- LoD selection and clean-up

def keep_lods(rows: DataFrame, lods: Iterable[str] | None = None, mode: str = "keep") -> DataFrame:
    """Filter property rows with a ``root_id`` by LoD; rows without LoD stay.

    ``keep`` and ``remove`` test the list. ``minimum`` and ``maximum`` keep one LoD per root, the least or greatest
    string among those allowed; without such a LoD, all rows with a LoD go.
    """
    lods = list(lods or [])
    plain, lod = F.col("val_lod").isNull(), F.col("val_lod")
    if mode in ("keep", "remove"):
        if not lods:
            return rows
        return rows.where(plain | (lod.isin(lods) if mode == "keep" else ~lod.isin(lods)))
    if mode not in ("minimum", "maximum"):
        raise ModelError(f"unknown LoD mode {mode!r}")
    allowed = rows.where(lod.isin(lods) if lods else lod.isNotNull())
    pick = F.min if mode == "minimum" else F.max
    target = allowed.groupBy("root_id").agg(pick("val_lod").alias("_target"))
    return rows.join(target, "root_id", "left").where(plain | (lod == F.col("_target"))).drop("_target")


def drop_empty(m: CityModel, rows: DataFrame) -> DataFrame:
    """After LoDs were removed: drop sub-features without any geometry in their sub-tree, references to them, and properties that hold an appearance
    without surface data.

    ``rows`` are property rows with ``root_id`` (the survivors of :func:`keep_lods`); roots always stay. What the rows that are left still paint is
    found by :func:`map_surface_data` and :func:`drop_empty_surface_data`.
    """
    # the steps below need ids only, so the property table is met once for all of them
    ids = checkpointed(rows.select("root_id", "feature_id", "val_feature_id", F.coalesce(F.col("val_relation_type") == CONTAINS, F.lit(False)).alias("held"),
                                   (F.col("val_geometry_id").isNotNull() | F.col("val_implicitgeom_id").isNotNull()).alias("shaped")))
    shaped = ids.where("shaped").select("root_id", F.col("feature_id").alias("node_id")).distinct()
    # walk up: a containing feature is not empty if something inside it is not
    up = ids.where("held and val_feature_id is not null").select("root_id", F.col("val_feature_id").alias("node_id"), F.col("feature_id").alias("owner"))
    frontier = full = checkpointed(shaped)
    while not frontier.isEmpty():
        lifted = frontier.join(up, ["root_id", "node_id"]).select("root_id", F.col("owner").alias("node_id")).distinct()
        frontier = checkpointed(lifted.join(full, ["root_id", "node_id"], "left_anti"))
        full = full.unionByName(frontier)
    keep = full.unionByName(ids.select("root_id", F.col("root_id").alias("node_id"))).distinct()
    mine = keep.select("root_id", F.col("node_id").alias("feature_id"))
    targets = keep.select("root_id", F.col("node_id").alias("val_feature_id"))
    # references to features outside the tree are left alone; only those to dropped members go
    members = up.select("root_id", F.col("node_id").alias("val_feature_id")).distinct()
    gone = members.join(targets, ["root_id", "val_feature_id"], "left_anti")
    rows = rows.join(mine, ["root_id", "feature_id"], "left_semi").join(gone, ["root_id", "val_feature_id"], "left_anti")
    painting = rows.where("val_appearance_id is not null")
    if painting.isEmpty():
        return rows
    _, appearances = drop_empty_surface_data(map_surface_data(m, rows), m)
    alive = appearances.select("root_id", F.col("id").alias("val_appearance_id"))
    return rows.where("val_appearance_id is null").unionByName(painting.join(alive, ["root_id", "val_appearance_id"], "left_semi"), allowMissingColumns=False)


def drop_empty_surface_data(mapped: DataFrame, m: CityModel) -> tuple[DataFrame, DataFrame]:
    """Surface data that still has a target, and appearances that still have surface data.

    ``mapped`` is the output of :func:`map_surface_data`; if it has a ``root_id``, both come once for each root that they paint.
    """
    if "root_id" in mapped.columns:
        data = m.surface_data.join(mapped.select("root_id", F.col("surface_data_id").alias("id")).distinct(), "id")
        links = m.appear_to_surface_data.join(data.select("root_id", F.col("id").alias("surface_data_id")), "surface_data_id")
        return data, m.appearance.join(links.select("root_id", F.col("appearance_id").alias("id")).distinct(), "id")
    data = m.surface_data.join(mapped.select(F.col("surface_data_id").alias("id")), "id", "left_semi")
    links = m.appear_to_surface_data.join(data.select(F.col("id").alias("surface_data_id")), "surface_data_id",
                                          "left_semi")
    appearances = m.appearance.join(links.select(F.col("appearance_id").alias("id")), "id", "left_semi")
    return data, appearances


# -- envelopes

def own_envelopes(m: CityModel, properties: DataFrame | None = None) -> DataFrame:
    """(feature_id, envelope): the box around a feature's own geometries and placed templates.

    Only geometries and templates that ``properties`` (default: all) name are measured, a template once however often it is placed.
    """
    rows = m.property if properties is None else properties
    world = rows.where("val_geometry_id is not null").select("feature_id", "val_geometry_id")
    placed = rows.where("val_implicitgeom_id is not null").select(
        "feature_id", "val_implicitgeom_id", F.from_json("val_array", "array<double>").alias("matrix"), "val_implicitgeom_refpoint")
    g = m.geometry_data.select("id", "primitives")
    used = g if properties is None else g.join(world.select(F.col("val_geometry_id").alias("id")), "id", "left_semi")
    boxes = used.select(F.col("id").alias("val_geometry_id"), geo.envelope_of("primitives").alias("box"))
    templates = m.implicit_geometry.select(F.col("id").alias("val_implicitgeom_id"), F.col("relative_geometry_id").alias("id"))
    if properties is not None:
        templates = templates.join(placed.select("val_implicitgeom_id"), "val_implicitgeom_id", "left_semi")
    shapes = templates.join(g.join(templates.select("id"), "id", "left_semi").select("id", geo.envelope_of("primitives").alias("shape")), "id", "left")
    placed = placed.join(shapes.drop("id"), "val_implicitgeom_id", "left").select(
        "feature_id", geo.template_envelope(F.col("shape"), F.col("matrix"), F.col("val_implicitgeom_refpoint")).alias("box"))
    return world.join(boxes, "val_geometry_id").select("feature_id", "box").unionByName(placed).groupBy("feature_id").agg(
        env.extent("box").alias("envelope"))


def contained(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): everything contained in any of the roots (first column), themselves included; each node once, whatever holds it."""
    frontier = checkpointed(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    known = frontier
    while not frontier.isEmpty():
        below = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = checkpointed(below.join(known, "node", "left_anti"))
        known = known.unionByName(frontier)
    return known


def lifted_envelopes(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, envelope): the boxes of ``own`` (node, envelope) joined up through ``edges`` (parent, child), level by level.

    Only boxes that have just grown are sent on, and each parent joins what comes in before the shuffle, so a round moves at most one row an edge, a
    child that several parents hold is counted for each, and cycles end when nothing grows. Rounds are as many as the tree is deep.
    """
    frontier = checkpointed(own.where("envelope is not null").select("node", "envelope"))
    known = frontier
    while not frontier.isEmpty():
        up = frontier.join(edges, frontier["node"] == edges["child"]).groupBy(F.col("parent").alias("node")).agg(env.extent("envelope").alias("envelope"))
        so_far = known.join(up.select("node"), "node", "left_semi").withColumn("old", F.lit(True))
        both = up.withColumn("old", F.lit(False)).unionByName(so_far)
        grown = both.groupBy("node").agg(env.extent("envelope").alias("envelope"), env.extent(F.when(F.col("old"), F.col("envelope"))).alias("before"))
        frontier = checkpointed(grown.where(~F.col("envelope").eqNullSafe(F.col("before"))).select("node", "envelope"))
        known = known.unionByName(frontier)
    return known.groupBy("node").agg(env.extent("envelope").alias("envelope"))


def update_envelopes(m: CityModel, features: DataFrame | None = None) -> DataFrame:
    """The feature table, or ``features`` of it, with envelopes recomputed bottom-up from everything contained; unchanged where that is empty."""
    edges = checkpointed(contains_edges(m).select("parent", "child"))
    properties = None
    if features is not None:
        inside = checkpointed(contained(edges, features.select("id")))
        edges = edges.join(inside.select(F.col("node").alias("parent")), "parent", "left_semi")
        properties = m.property.join(inside.select(F.col("node").alias("feature_id")), "feature_id", "left_semi")
    features = m.feature if features is None else features
    boxes = lifted_envelopes(edges, own_envelopes(m, properties).withColumnRenamed("feature_id", "node"))
    joined = features.join(boxes.select(F.col("node").alias("id"), F.col("envelope").alias("_new")), "id", "left")
    return joined.withColumn("envelope", F.coalesce("_new", "envelope")).drop("_new").select(*features.columns)


# -- surface data

_MAPPINGS = {
    "material_mapping": "material", "georeferenced_texture_mapping": "georeferenced",
    "texture_mapping": "texture", "world_to_texture_mapping": "world_to_texture",
}


def map_surface_data(m: CityModel, rows: DataFrame | None = None) -> DataFrame:
    """Bind mapping documents to surfaces: (surface_data_id, geometry_data_id, object_id, kind, value).

    Each document maps surface object ids to ``true``, to ring coordinates, or to a matrix. An entry binds to the
    surface of that object id inside that geometry; texture rings bind only to a polygon with as many rings.
    With ``rows`` (property rows with ``root_id``) it binds to the geometries and templates that these name, once for each ``root_id``.
    """
    if rows is not None:
        templates = m.implicit_geometry.select(F.col("id").alias("val_implicitgeom_id"), F.col("relative_geometry_id").alias("geometry_data_id"))
        placed = rows.where("val_implicitgeom_id is not null").select("root_id", "val_implicitgeom_id").join(templates, "val_implicitgeom_id").select("root_id", "geometry_data_id")
        named = rows.where("val_geometry_id is not null").select("root_id", F.col("val_geometry_id").alias("geometry_data_id")).unionByName(placed)
        named = checkpointed(named.join(m.surface_data_mapping.select("geometry_data_id"), "geometry_data_id", "left_semi").distinct())
        mapping = checkpointed(m.surface_data_mapping.join(named.select("geometry_data_id"), "geometry_data_id", "left_semi").select(*m.surface_data_mapping.columns))
        return map_surface_data(m.replace(surface_data_mapping=mapping)).join(named, "geometry_data_id")
    parts = []
    for column, kind in _MAPPINGS.items():
        entries = m.surface_data_mapping.where(F.col(column).isNotNull()).select(
            "surface_data_id", "geometry_data_id",
            F.explode(F.from_json(column, "map<string,string>")).alias("object_id", "value"))
        is_array = F.col("value").startswith("[")
        if kind in ("material", "georeferenced"):
            entries = entries.where("value = 'true'")
        elif kind == "texture":
            rings = F.from_json("value", "array<array<array<double>>>")
            points = lambda ring: F.filter(ring, lambda p: (F.size(p) > 1) & F.get(p, 0).isNotNull()
                                           & F.get(p, 1).isNotNull())
            filled = F.filter(F.transform(rings, points), lambda ring: F.size(ring) > 0)
            entries = entries.where(is_array).withColumn("ring_count", F.size(filled)).where("ring_count > 0")
        else:
            entries = entries.where(is_array)
        if "ring_count" not in entries.columns:
            entries = entries.withColumn("ring_count", F.lit(None).cast("int"))
        parts.append(entries.withColumn("kind", F.lit(kind)))
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    surfaces = geo.flatten_geometry(m.geometry_data.select("id", "nodes", "primitives")).where(
        F.col("type").isin(5, 6, 7, 8)).select(
        F.col("id").alias("geometry_data_id"), "object_id", "type", F.size("rings").alias("rings"))
    bound = entries.join(surfaces, ["geometry_data_id", "object_id"])
    fits = F.when(F.col("kind") == "texture", (F.col("type") == 5) & (F.col("rings") == F.col("ring_count")))
    return bound.where(fits.isNull() | fits).select(
        "surface_data_id", "geometry_data_id", "object_id", "kind", "value")
