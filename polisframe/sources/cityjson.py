"""CityJSON text sequences: a header line, then one feature per line. Reading and writing as Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions import geometry as geo
from polisframe.model import CONTAINS, GEOMETRY_NAMES, CityModel
from polisframe.operators.hierarchy import closure, contains_edges
from polisframe.operators.loading import assign_ids
from polisframe.runtime import checkpointed, number_rows

_LINE = (
    "type string, id string, transform struct<scale:array<double>,translate:array<double>>, "
    "vertices array<array<double>>, CityObjects map<string,struct<type:string,attributes:variant,"
    "parents:array<string>,children:array<string>,geometry:array<struct<type:string,lod:string,boundaries:string,template:int,"
    "transformationMatrix:array<double>>>>>, "
    "`geometry-templates` struct<templates:array<struct<type:string,lod:string,boundaries:string>>,`vertices-templates`:array<array<double>>>"
)
_CODES = {"MultiPoint": 2, "MultiLineString": 4, "CompositeSurface": 6, "MultiSurface": 8, "Solid": 9,
          "CompositeSolid": 10, "MultiSolid": 11}
_RINGS = "array<array<array<int>>>"


def _lines(spark: SparkSession, path: str, whole_documents: bool) -> DataFrame:
    text = spark.read.text(path, wholetext=whole_documents).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.from_json("value", _LINE).alias("d")).select("file", "d.*")


def read_templates(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """The geometry templates of the files: (file, template, template_key, lod, geometry_type, nodes, primitives).

    ``template`` is the place in the file's list, ``template_key`` a hash of the shape, so that files that bring the same template agree.
    """
    lines = _lines(spark, path, whole_documents).select("file", F.col("geometry-templates").alias("t")).where("t.templates is not null")
    listed = lines.select("file", F.col("t.vertices-templates").alias("points"), F.posexplode("t.templates").alias("template", "g")).where(F.col("g.type").isin(list(_CODES)))
    shaped = listed.select("file", "template", _geometry(F.col("g"), F.col("points")).alias("s")).select("file", "template", "s.*")
    key = F.concat(F.lit("template-"), F.md5(F.to_json(F.struct("geometry_type", "nodes", "primitives"))))
    return shaped.withColumn("template_key", key)


def read_cityjson(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """City objects of newline-delimited files (or of whole documents, one per file), ready for ``shred``.

    Columns: file, seq, objectid, parent_objectid (the first of ``parents``), parents, root_objectid, classname, envelope, attributes (VARIANT),
    geometries, and placements of templates (lod, template_key, matrix, reference_point; null if there are none). Coordinates are
    de-quantised with the transform of the line, else of the file's header.
    """
    lines = _lines(spark, path, whole_documents)
    header = lines.where("type = 'CityJSON' and transform is not null").groupBy("file").agg(
        F.first("transform").alias("file_transform"))
    lines = lines.where("CityObjects is not null and size(CityObjects) > 0").drop("geometry-templates").join(header, "file", "left")
    t = F.coalesce("transform", "file_transform")
    at = lambda v, i: F.get(v, i) * F.coalesce(F.get(t["scale"], i), F.lit(1.0)) + F.coalesce(
        F.get(t["translate"], i), F.lit(0.0))
    lines = lines.withColumn("points", F.transform("vertices", lambda v: F.array(at(v, 0), at(v, 1), at(v, 2))))
    objects = lines.select("file", F.col("id").alias("root_objectid"), "points",
                           F.explode("CityObjects").alias("objectid", "o"))
    every = F.coalesce("o.geometry", F.array())
    shaped = F.transform(F.filter(every, lambda g: g["type"].isin(list(_CODES))), lambda g: _geometry(g, F.col("points")))
    placed = F.transform(F.filter(every, lambda g: g["type"] == "GeometryInstance"), lambda g: F.struct(
        g["template"].alias("template"), g["transformationMatrix"].alias("matrix"),
        F.get(F.col("points"), F.get(F.from_json(g["boundaries"], "array<int>"), 0)).alias("reference_point")))
    objects = objects.select(
        "file", "objectid", F.get("o.parents", 0).alias("parent_objectid"), F.col("o.parents").alias("parents"),
        F.coalesce("root_objectid", "objectid").alias("root_objectid"), F.col("o.type").alias("classname"),
        F.col("o.attributes").alias("attributes"), shaped.alias("geometries"), placed.alias("placed"))
    box = env.of_points(F.flatten(F.transform("geometries", lambda g: F.flatten(F.flatten(g["primitives"])))))
    numbered = assign_ids(objects.withColumn("envelope", box), 0, name="seq")
    known = read_templates(spark, path, whole_documents).select("file", "template", "template_key", "lod")
    found = numbered.where("size(placed) > 0").select("seq", "file", F.posexplode("placed").alias("nth", "p")).select("seq", "file", "nth", "p.*").join(
        known, ["file", "template"]).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            "nth", "lod", "template_key", "matrix", "reference_point"))), lambda x: x.dropFields("nth")).alias("placements"))
    return numbered.drop("placed").join(found, "seq", "left")


def _geometry(g: Column, points: Column) -> Column:
    """One geometry object: type code, LoD, the tree of its parts, and closed rings of coordinates."""
    kind, text = g["type"], g["boundaries"]
    code = F.lit(None).cast("int")
    for name, value in _CODES.items():
        code = F.when(kind == name, value).otherwise(code)
    singles = F.transform(F.from_json(text, "array<int>"), lambda i: F.array(F.array(i)))
    lines = F.transform(F.from_json(text, "array<array<int>>"), lambda line: F.array(line))
    surfaces = F.from_json(text, _RINGS)
    shells = F.when(kind == "Solid", F.array(F.from_json(text, f"array<{_RINGS}>"))).otherwise(
        F.from_json(text, f"array<array<{_RINGS}>>"))
    is_solid = kind.isin("Solid", "MultiSolid", "CompositeSolid")
    rings = (F.when(kind == "MultiPoint", singles).when(kind == "MultiLineString", lines)
             .when(is_solid, F.flatten(F.flatten(shells))).otherwise(surfaces))
    vertex = lambda i: F.get(points, i)
    is_area = ~kind.isin("MultiPoint", "MultiLineString")

    def ring_points(ring: Column) -> Column:
        open_ = F.transform(ring, vertex)
        return F.when(is_area, F.concat(open_, F.array(vertex(F.get(ring, 0))))).otherwise(open_)

    primitives = F.transform(rings, lambda p: F.transform(p, ring_points))

    def node(type_: Column, parent: Column, index: Column) -> Column:
        return F.struct(type_.cast("int").alias("type"), F.lit(None).cast("string").alias("object_id"),
                        parent.cast("int").alias("parent"), index.cast("int").alias("geometry_index"),
                        F.lit(None).cast("boolean").alias("is_reversed"))

    none = F.lit(None)
    leaf = F.when(kind == "MultiPoint", 1).when(kind == "MultiLineString", 3).otherwise(5)
    plain = F.transform(primitives, lambda p, i: node(leaf, F.lit(0), i))
    # solids: root, (solids of a collection), shells, polygons; a parent is a position in this list
    many = kind != "Solid"
    solids = F.when(many, F.transform(shells, lambda s: node(F.lit(9), F.lit(0), none))).otherwise(F.array())
    first_shell = F.lit(1) + F.size(solids)
    shell_nodes = F.flatten(F.transform(shells, lambda s, i: F.transform(
        s, lambda _: node(F.lit(6), F.when(many, i + 1).otherwise(0), none))))
    owner = F.flatten(F.transform(F.flatten(shells), lambda sh, i: F.transform(sh, lambda _: i + first_shell)))
    polygons = F.transform(owner, lambda o, i: node(F.lit(5), o, i))
    nodes = F.concat(F.array(node(code, none, none)),
                     F.when(is_solid, F.concat(solids, shell_nodes, polygons)).otherwise(plain))
    return F.struct(g["lod"].alias("lod"), code.alias("geometry_type"), nodes.alias("nodes"),
                    primitives.alias("primitives"))


def with_classes(objects: DataFrame, m: CityModel, map_unknown: str | None = None) -> DataFrame:
    """Add objectclass_id by class name, in any case; unknown names become ``map_unknown``, or are dropped."""
    names = m.objectclass.where("is_abstract = 0").select(F.col("id").alias("objectclass_id"),
                                                          F.lower("classname").alias("_name"))
    out = objects.withColumn("_name", F.lower("classname")).join(names, "_name", "left").drop("_name")
    if map_unknown is None:
        return out.where("objectclass_id is not null")
    return out.withColumn("objectclass_id", F.coalesce("objectclass_id", F.lit(m.types.lookup(map_unknown)["id"])))


# -- writing

def cityjson_lines(m: CityModel, roots: DataFrame, precision: int = 3) -> tuple[DataFrame, DataFrame]:
    """The header line as one row (value), and one row (root_id, value) per feature line.

    The format holds a feature with all its objects in one line, so a line is put together in one task. An object's
    attributes are all its values (several of one name become a list, nested ones an object), its parents and children those
    in the feature. Coordinates are rounded to ``precision`` decimals.
    """
    edges = checkpointed(contains_edges(m))
    tree = closure(edges, roots, reuse_edges=False)
    edges = edges.select("parent", F.col("child").alias("node_id"))
    names = m.objectclass.select(F.col("id").alias("objectclass_id"), "classname")
    features = m.feature.select("id", "objectid", "objectclass_id").join(names, "objectclass_id")
    # what the lines hold is written before it meets a whole table: a small part of a model then is sent to that table's tasks
    nodes = checkpointed(tree.join(features, tree["node_id"] == features["id"]).select("root_id", "node_id", "objectid", "classname"))
    inside = nodes.select("root_id", "node_id", "objectid")
    up = inside.withColumnsRenamed({"node_id": "parent", "objectid": "parent_objectid"})
    pairs = inside.join(edges, "node_id").join(up, ["root_id", "parent"])  # of objects of one feature
    parents = pairs.groupBy("root_id", "node_id").agg(F.sort_array(F.collect_set("parent_objectid")).alias("parents"))
    children = pairs.groupBy("root_id", F.col("parent").alias("node_id")).agg(F.sort_array(F.collect_set("objectid")).alias("children"))
    attributes = _attribute_objects(m, nodes)

    templates = _used_templates(m, nodes)
    geometry = _geometry_objects(m, nodes, precision, templates)
    nodes = nodes.join(parents, ["root_id", "node_id"], "left").join(children, ["root_id", "node_id"], "left")
    body = nodes.join(attributes, "node_id", "left").join(geometry["objects"], ["root_id", "node_id"], "left")
    objects = body.groupBy("root_id").agg(F.map_from_entries(F.collect_list(F.struct("objectid", F.struct(
        F.col("classname").alias("type"), "attributes", "parents", "children", "geometry")))).alias("CityObjects"))
    ids = m.feature.select(F.col("id").alias("root_id"), F.col("objectid").alias("id"))
    lines = objects.join(geometry["vertices"], ["root_id"], "left").join(ids, "root_id")
    line = F.struct(F.lit("CityJSONFeature").alias("type"), "id", "CityObjects",
                    F.coalesce("vertices", F.array().cast("array<array<bigint>>")).alias("vertices"))
    return _header(m, templates, precision), lines.select("root_id", _unquoted(F.to_json(line)).alias("value"))


def _used_templates(m: CityModel, nodes: DataFrame) -> DataFrame:
    """(val_implicitgeom_id, val_lod, template, gid): the templates that the nodes place, with their place in the header's list."""
    shapes = m.implicit_geometry.where("relative_geometry_id is not null").select(F.col("id").alias("val_implicitgeom_id"), F.col("relative_geometry_id").alias("gid"))
    used = m.property.where("val_implicitgeom_id is not null").join(nodes.select(F.col("node_id").alias("feature_id")), "feature_id", "left_semi")
    distinct = used.select("val_implicitgeom_id", "val_lod").distinct().join(shapes, "val_implicitgeom_id")
    return number_rows(distinct, [F.col("val_implicitgeom_id"), F.col("val_lod")], "template", 0)


def _shapes(m: CityModel) -> DataFrame:
    return m.geometry_data.select(F.col("id").alias("gid"), "geometry_type", F.col("primitives"),
                                  F.transform(F.filter("nodes", lambda n: n["geometry_index"].isNotNull()), lambda n: n["parent"]).alias("shells"))


def _geometry_objects(m: CityModel, nodes: DataFrame, precision: int, templates: DataFrame) -> dict[str, DataFrame]:
    """Geometry arrays per object and vertex arrays per line, placements of ``templates`` among them."""
    used = m.property.where("val_geometry_id is not null").select(
        F.col("feature_id").alias("node_id"), F.col("val_geometry_id").alias("gid"), "val_lod")
    rows = checkpointed(nodes.select("root_id", "node_id").join(used, "node_id")).join(_shapes(m), "gid")
    placed = m.property.where("val_implicitgeom_id is not null").select(
        F.col("feature_id").alias("node_id"), (-F.col("id")).alias("gid"), "val_lod", "val_implicitgeom_id", F.from_json("val_array", "array<double>").alias("matrix"),
        F.col("val_implicitgeom_refpoint").alias("p"))
    placed = checkpointed(nodes.select("root_id", "node_id").join(placed, "node_id")).join(templates.select("val_implicitgeom_id", F.col("val_lod").alias("_lod"), "template"), "val_implicitgeom_id").where(
        F.col("val_lod").eqNullSafe(F.col("_lod"))).drop("_lod", "val_implicitgeom_id")
    return _boundaries(rows, placed, precision)


def _boundaries(rows: DataFrame, placed: DataFrame | None, precision: int) -> dict[str, DataFrame]:
    """Points are numbered inside each line by a window, whose group is one line; the four levels of arrays are put together on
    the same partitioning. ``placed`` has one point (p) each, beside its matrix and template."""
    rows = rows.repartition("root_id")
    key = ["root_id", "node_id", "gid", "val_lod", "geometry_type"]
    prims = rows.select(*key, "shells", F.posexplode("primitives").alias("prim", "rings"))
    prims = prims.withColumn("shell", F.get("shells", F.col("prim"))).drop("shells")
    area = F.col("geometry_type") >= 5
    rings = prims.select(*key, "prim", "shell", F.posexplode("rings").alias("ring", "points"))
    rings = rings.withColumn("points", F.when(area, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points")))
    points = rings.select(*key, "prim", "shell", "ring", F.posexplode("points").alias("pos", "p"))
    if placed is not None:
        points = points.unionByName(placed.select("root_id", "node_id", "gid", "val_lod", F.lit(0).alias("geometry_type"), F.lit(0).alias("prim"), F.lit(None).cast("int").alias("shell"),
                                                  F.lit(0).alias("ring"), F.lit(0).alias("pos"), "p"))
    q = lambda i: F.round(F.coalesce(F.get("p", i), F.lit(0.0)) * 10 ** precision).cast("bigint")
    order = Window.partitionBy("root_id").orderBy("node_id", "gid", "val_lod", "prim", "ring", "pos")
    points = points.withColumn("n", F.row_number().over(order) - 1).withColumn("v", F.array(q(0), q(1), q(2)))
    vertices = points.groupBy("root_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda s: s["v"]).alias("vertices"))
    ring = points.where("geometry_type > 0").groupBy(*key, "prim", "shell", "ring").agg(F.array_sort(F.collect_list("n")).alias("ix"))
    prim = ring.groupBy(*key, "prim", "shell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ring", "ix"))), lambda s: s["ix"]).alias("rings"))
    shell = prim.groupBy(*key, "shell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prim", "rings"))), lambda s: s["rings"]).alias("surfaces"))
    whole = shell.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shell", "surfaces"))), lambda s: s["surfaces"]).alias("shells"))
    flat = F.flatten("shells")
    text = (F.when(F.col("geometry_type") == 9, F.to_json("shells"))
            .when(F.col("geometry_type") >= 10, F.to_json(F.transform("shells", lambda s: F.array(s))))
            .when(area, F.to_json(flat)).when(F.col("geometry_type") >= 3, F.to_json(F.flatten(flat)))
            .otherwise(F.to_json(F.flatten(F.flatten(flat)))))
    names = F.create_map(*[F.lit(v) for c, n in GEOMETRY_NAMES.items() for v in (
        c, {"Point": "MultiPoint", "LineString": "MultiLineString", "Polygon": "MultiSurface",
            "TriangulatedSurface": "CompositeSurface"}.get(n, n))])
    quoted = lambda t: F.concat(F.lit("@"), t, F.lit("@"))
    none = F.lit(None)
    geometry = whole.select("root_id", "node_id", F.struct(
        names[F.col("geometry_type")].alias("type"), F.col("val_lod").alias("lod"), quoted(text).alias("boundaries"), none.cast("bigint").alias("template"),
        none.cast("array<double>").alias("transformationMatrix")).alias("g"))
    if placed is not None:
        spots = points.where("geometry_type = 0").select("root_id", "node_id", "gid", "n")
        geometry = geometry.unionByName(placed.join(spots, ["root_id", "node_id", "gid"]).select("root_id", "node_id", F.struct(
            F.lit("GeometryInstance").alias("type"), none.cast("string").alias("lod"), quoted(F.to_json(F.array("n"))).alias("boundaries"), F.col("template"),
            F.col("matrix").alias("transformationMatrix")).alias("g")))
    objects = geometry.groupBy("root_id", "node_id").agg(F.sort_array(F.collect_list("g")).alias("geometry"))
    return {"objects": objects, "vertices": vertices}


def _header(m: CityModel, templates: DataFrame, precision: int) -> DataFrame:
    """One row (value): the header line, with the templates in their order and their own, unscaled vertices."""
    rows = templates.select(F.lit(0).cast("bigint").alias("root_id"), F.col("template").alias("node_id"), "gid", "val_lod").join(_shapes(m), "gid")
    made = _boundaries(rows, None, precision)
    listed = made["objects"].groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.get("geometry", 0).alias("g")))), lambda x: x["g"].dropFields(
        "template", "transformationMatrix")).alias("templates"))
    scale = 10.0 ** -precision
    vertices = made["vertices"].select("root_id", F.transform("vertices", lambda v: F.transform(v, lambda x: F.round(x * scale, precision))).alias("vertices-templates"))
    transform = F.struct(F.array(*[F.lit(scale)] * 3).alias("scale"), F.array(*[F.lit(0.0)] * 3).alias("translate"))
    one = m.spark.range(1).select(F.col("id").alias("root_id")).join(listed, "root_id", "left").join(vertices, "root_id", "left")
    given = F.when(F.col("templates").isNotNull(), F.struct("templates", "vertices-templates")).alias("geometry-templates")
    line = F.struct(F.lit("CityJSON").alias("type"), F.lit("2.0").alias("version"), transform.alias("transform"), F.from_json(F.lit("{}"), "map<string,string>").alias("CityObjects"),
                    F.array().cast("array<array<bigint>>").alias("vertices"), given)
    return one.select(_unquoted(F.to_json(line)).alias("value"))


def _unquoted(text: Column) -> Column:
    """Boundaries are JSON text already: the quoted marker around them is taken off."""
    return F.regexp_replace(text, r'"@([\[\],0-9]*)@"', "$1")


def write_cityjson(m: CityModel, roots: DataFrame, path: str, precision: int = 3, files: int | None = None) -> None:
    """Write features as CityJSON text sequences: folders ``file=0 …``, each a readable sequence with its header first.

    ``files``: how many; as many as the session has shuffle partitions, if not given.
    """
    header, lines = cityjson_lines(m, roots, precision)
    spark = m.spark
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = lines.select(F.pmod(F.xxhash64("root_id"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("place"), "root_id", "value")
    heads = header.select(F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("file"), F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("root_id"), "value")
    out = heads.unionByName(body).repartition(files, "file").sortWithinPartitions("file", "place", "root_id")
    out.select("file", "value").write.partitionBy("file").mode("errorifexists").text(path)


def _attribute_objects(m: CityModel, nodes: DataFrame) -> DataFrame:
    """(node_id, attributes) with every attribute value as VARIANT; nested attributes are put into their parents level by level."""
    text = F.coalesce(F.to_json(F.col("val_string").cast("variant")), F.to_json(F.col("val_int").cast("variant")),
                      F.to_json(F.col("val_double").cast("variant")), F.to_json(F.try_parse_json("val_array")),
                      F.to_json(F.date_format("val_timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").cast("variant")), F.to_json(F.col("val_uri").cast("variant")))
    rows = m.property.where("val_lod is null and val_feature_id is null and val_geometry_id is null and val_implicitgeom_id is null "
                            "and val_appearance_id is null and val_address_id is null")
    rows = rows.join(nodes.select(F.col("node_id").alias("feature_id")), "feature_id", "left_semi")
    rows = checkpointed(rows.select("id", "feature_id", "parent_id", "name", text.alias("text")))
    levels = [rows.where("parent_id is null")]
    while True:
        below = checkpointed(rows.join(levels[-1].select(F.col("id").alias("parent_id")), "parent_id", "left_semi"))
        if below.isEmpty():
            break
        levels.append(below)
    inner = None
    for level in reversed(levels):
        if inner is not None:
            level = level.join(inner.withColumnsRenamed({"owner": "id", "object": "nested"}), "id", "left").withColumn(
                "text", F.coalesce("nested", "text")).drop("nested")
        owner = F.coalesce("parent_id", "feature_id")
        inner = _objects_of(level.select(owner.alias("owner"), "name", "id", "text").where("text is not null"))
    return inner.select(F.col("owner").alias("node_id"), F.parse_json("object").alias("attributes"))


def _objects_of(pairs: DataFrame) -> DataFrame:
    """(owner, object): the JSON object of each owner's (name, text); several texts of one name become a list."""
    lists = pairs.groupBy("owner", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("all"))
    quoted = F.to_json(F.array("name"))
    entry = F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), F.when(F.size("all") == 1, F.get("all", 0)).otherwise(
        F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))))
    return lists.groupBy("owner").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("object"))
