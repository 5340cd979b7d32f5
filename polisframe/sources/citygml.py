"""CityGML files: members cut out of the text by Spark, elements unfolded into rows, objects and geometries put together from those."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.catalog import DATA_TYPES
from polisframe.functions import envelope as env
from polisframe.model import CityModel
from polisframe.operators.hierarchy import folded, unfolded
from polisframe.operators.loading import assign_ids
from polisframe.runtime import checkpointed

_GEOMETRY = {"Point": 1, "MultiPoint": 2, "LineString": 3, "MultiCurve": 4, "Polygon": 5, "CompositeSurface": 6,
             "TriangulatedSurface": 7, "MultiSurface": 8, "Solid": 9, "CompositeSolid": 10, "MultiSolid": 11}
#: Elements that are one primitive each, and those that are one ring each.
_PRIMITIVES = ["Polygon", "PolygonPatch", "Triangle", "Rectangle", "LineString", "LineStringSegment", "Point"]
_RINGS = ["LinearRing", "Ring"]
#: Generic attributes; those of the second kind are text, however they look.
_GENERIC = "(?i)^(string|uri|date|code|int|integer|double|measure)Attribute$"
_SET = "^genericAttributeSet$"
_TEXT = "(?i)^(string|uri|date|code)Attribute$"
_ELEMENT = "path array<int>, names array<string>, ids array<string>, text string, attributes map<string,string>, dim int"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per element of each member: its place and its ancestors' names and ids, own ones last, text, attributes, and dimension."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()]
    for batch in batches:
        rows: list[tuple] = []
        for file, nr, text in zip(*(batch.column(c).to_pylist() for c in ("file", "nr", "value")), strict=True):
            stack: list[list] = [[[], [], [], "", {}, 3, 0]]  # path, names, ids, text, attributes, dimension, children

            def start(name, attributes, stack=stack):
                above = stack[-1]
                dim = attributes.get("srsDimension", "")
                stack.append([[*above[0], above[6]], [*above[1], name], [*above[2], attributes.get("gml:id") or attributes.get("id")], "", attributes,
                              int(dim) if dim.isdigit() and int(dim) > 1 else above[5], 0])
                above[6] += 1

            def end(_, stack=stack, file=file, nr=nr):
                path, names, ids, content, attributes, dim, _ = stack.pop()
                rows.append((file, nr, path, names, ids, content.strip() or None, list(attributes.items()), dim))

            def content(data, stack=stack):
                stack[-1][3] += data

            parser = expat.ParserCreate()
            parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, content
            parser.Parse(f"<member>{text}</member>", True)
            rows.pop()  # the member itself
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        columns[2:5] = [[x[1:] for x in c] for c in columns[2:5]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "nr", "path", "names", "ids", "text", "attributes", "dim"])


def _local(name: Column) -> Column:
    return F.regexp_replace(name, "^.*:", "")


def _is_object(name: Column) -> Column:
    """Upper-case elements are objects, but for geometry, boxes, generic attributes and placed templates."""
    local = _local(name)
    return local.rlike("^[A-Z]") & ~name.startswith("gml:") & ~local.isin("Envelope", "ImplicitGeometry") & ~local.rlike(_GENERIC)


def _last_of(names: list[str]) -> Column:
    """The place of the innermost element of these names, from 0."""
    return F.array_max(F.transform("names", lambda x, i: F.when(_local(x).isin(names), i)))


def _id_at(place: Column) -> Column:
    """The id of the object at a place of the path; a made one if it has none."""
    made = F.concat(F.lit("generated-"), F.md5(F.concat_ws("/", "file", F.col("nr").cast("string"), F.array_join(F.slice("path", 1, place + 1).cast("array<string>"), "."))))
    return F.coalesce(F.get("ids", place), made)


def read_elements(spark: SparkSession, path: str, member: str) -> DataFrame:
    """All elements of the members of the files, with the place of the object each belongs to (``owner``) and of its geometry (``shape``)."""
    text = spark.read.text(path, lineSep=f"</{member}>")
    inner = F.nullif(F.regexp_extract("value", rf"(?s)<{member}(?:\s[^>]*)?>(.*)$", 1), F.lit(""))
    members = text.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nr"), inner.alias("value")).where("value is not null")
    rows = members.mapInArrow(_elements, f"file string, nr bigint, {_ELEMENT}")
    # an element that only names the type of its property's value stands for nothing
    is_type = lambda name: _local(name).isin([t for _, t in DATA_TYPES if t != "GenericAttributeSet"]) & ~name.startswith("gml:")
    typed = F.exists("names", is_type)
    kept = lambda column: F.when(typed, F.filter(column, lambda _, i: ~is_type(F.get("names", i)))).otherwise(F.col(column))
    rows = checkpointed(rows.where(~is_type(F.element_at("names", -1))).withColumns({"path": kept("path"), "ids": kept("ids"), "names": kept("names")}))
    here = F.size("names") - 1
    objects = F.filter(F.transform("names", lambda x, i: F.when(_is_object(x), i)), lambda i: i.isNotNull())
    owner = F.array_max(F.filter(objects, lambda i: i < here))
    shape = F.array_min(F.filter(F.transform("names", lambda x, i: F.when(x.startswith("gml:") & _local(x).isin(list(_GEOMETRY)), i)), lambda i: i > F.coalesce(owner, F.lit(-1))))
    return rows.select("*", here.alias("here"), F.array_contains(objects, here).alias("is_object"), owner.alias("owner"), shape.alias("shape"),
                       F.exists("names", lambda x: _local(x) == "ImplicitGeometry").alias("placed"))


def read_citygml(spark: SparkSession, path: str, member: str = "core:cityObjectMember", lod4_as_lod3: bool = False,
                 ) -> DataFrame:
    """City objects of XML files, with the columns of ``read_cityjson``, ready for ``shred``.

    Members are cut at their closing tags, so large files are read in splits. Elements are mapped by name: an upper-case GML geometry inside a property
    becomes a geometry (its LoD is the digit after ``lod`` in the property name), an upper-case element in any other namespace a
    sub-object, all else an attribute; elements inside an attribute nest, and several of one name become a list. Values are numbers or
    truth values only if written like one (``007`` is text), ``units`` has their units by name.

    Rings are read from ``gml:posList`` or from ``gml:pos`` one by one, in as many dimensions as ``srsDimension`` says
    (three, if nothing does); polygons, patches and triangles are one primitive each, in document order. A member given by reference
    (``xlink:href="#…"``) takes the polygons of the element with that id in the same file, and nodes keep polygons' ids.
    ``unreadable`` names the properties whose geometry gave no coordinates, whose references lead nowhere, or that place a template.
    """
    rows = read_elements(spark, path, member)
    objects = rows.where("is_object").select(
        "file", "nr", _id_at(F.col("here")).alias("objectid"), F.when(F.col("owner").isNotNull(), _id_at(F.col("owner"))).alias("parent_objectid"),
        _id_at(F.lit(0)).alias("root_objectid"), _local(F.get("names", F.col("here"))).alias("classname"),
        F.when(F.col("owner").isNotNull(), _local(F.get("names", F.col("here") - 1))).alias("parent_property"))
    owned = rows.where("not is_object and owner is not null").withColumn("objectid", _id_at(F.col("owner")))
    shapes = _geometries(owned.where("not placed"), lod4_as_lod3)
    template = F.col("placed") & (_local(F.get("names", F.col("here"))) == "ImplicitGeometry")
    lost = owned.where(template).groupBy("file", "nr", "objectid").agg(F.collect_list(_local(F.get("names", F.col("owner") + 1))).alias("templates"))
    key = ["file", "nr", "objectid"]
    out = objects.join(_attributes(owned.where("shape is null and not placed")), key, "left").join(shapes, key, "left").join(lost, key, "left").drop("nr")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(shapes.schema[name].dataType))
    out = out.withColumns({"geometries": empty("geometries"), "unreadable": F.concat(empty("unreadable"), F.coalesce("templates", F.array().cast("array<string>")))}).drop("templates")
    box = env.of_points(F.flatten(F.transform("geometries", lambda g: F.flatten(F.flatten(g["primitives"])))))
    return assign_ids(out.withColumn("envelope", box), 0, name="seq")


def _quoted(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return array.substr(F.lit(2), F.length(array) - 2)


def _attributes(owned: DataFrame) -> DataFrame:
    """(file, nr, objectid, attributes, units): each object's attributes as one VARIANT object, folded from the innermost elements out."""
    at = lambda place: F.array_join(F.slice("path", 1, place).cast("array<string>"), ".")
    name = _local(F.get("names", F.col("here")))
    plain = F.col("text").rlike(r"^-?(0|[1-9]\d{0,17})(\.\d+)?([eE][-+]?\d+)?$") | F.col("text").isin("true", "false")
    is_text = F.exists("names", lambda x: _local(x).rlike(_TEXT))
    # a generic attribute stands in for the property around it
    wrapped = _local(F.get("names", F.col("here") - 1)) == "genericAttribute"
    rows = checkpointed(owned.select(
        "file", "nr", "objectid", "here", at(F.col("here") + 1).alias("key"),
        F.when(F.col("here") == F.col("owner") + 1, F.lit(None)).when(wrapped & (F.col("here") == F.col("owner") + 2), F.lit(None)).otherwise(at(F.col("here"))).alias("parent"),
        F.coalesce(F.when(name.rlike(_GENERIC) | name.rlike(_SET), F.col("attributes")["name"]), name).alias("name"),
        name.rlike(_GENERIC).alias("generic"), F.col("attributes")["uom"].alias("uom"), "path", "text",
        F.when(F.col("text").isNotNull(), F.when(plain & ~is_text, F.col("text")).otherwise(_quoted(F.col("text")))).alias("json")))
    deepest = rows.agg(F.max("here")).first()[0]
    member = ["file", "nr", "objectid"]
    inner = None
    top = None
    for depth in range(deepest if deepest is not None else -1, 0, -1):
        level = rows.where(F.col("here") == depth)
        if inner is not None:
            level = level.join(inner, [*member, "key"], "left")
            level = level.withColumns({"json": F.coalesce(F.when(F.col("generic"), F.col("own_value")).otherwise(F.col("object")), "json"),
                                       "name": F.when(F.col("generic") & F.col("own_name").isNotNull(), F.col("own_name")).otherwise(F.col("name")), "uom": F.coalesce("uom", "own_uom")})
        # written once a level: it is read several times below, and a plan that held each level's plan as often would double with every level
        entries = checkpointed(level.where("json is not null").select(*member, "key", "parent", "name", "json", "path", "text", "uom"))
        above = entries.where("parent is null")
        top = above if top is None else top.unionByName(above)
        held = entries.where("parent is not null")
        inner = _objects_of(held, [*member, "parent"]).join(held.groupBy(*member, "parent").agg(
            F.first(F.when(F.col("name") == "value", F.col("json")), ignorenulls=True).alias("own_value"),
            F.first(F.when(F.col("name") == "name", F.col("text")), ignorenulls=True).alias("own_name"), F.first("uom", ignorenulls=True).alias("own_uom")),
            [*member, "parent"]).withColumnRenamed("parent", "key")
    if top is None:
        return owned.select(*member, F.lit(None).cast("variant").alias("attributes"), F.lit(None).cast("map<string,string>").alias("units")).where(F.lit(False))
    units = top.where("uom is not null").groupBy(*member, "name").agg(F.min("uom").alias("uom")).groupBy(*member).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "uom"))).alias("units"))
    return _objects_of(top, member).select(*member, F.parse_json("object").alias("attributes")).join(units, member, "left")


def _objects_of(entries: DataFrame, key: list[str]) -> DataFrame:
    """(key, object): the JSON object of each group's (name, json); several of one name become a list in document order."""
    lists = entries.groupBy(*key, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "json"))), lambda x: x["json"]).alias("all"))
    value = F.when(F.size("all") == 1, F.get("all", 0)).otherwise(F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")))
    entry = F.concat(_quoted(F.col("name")), F.lit(":"), value)
    return lists.groupBy(*key).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("object"))


def _geometries(owned: DataFrame, lod4_as_lod3: bool) -> DataFrame:
    """(file, nr, objectid, geometries, unreadable) of all geometry properties; references are looked up in the file."""
    kind = F.create_map(*[F.lit(x) for n, c in _GEOMETRY.items() for x in (n, c)])
    lod = F.nullif(F.regexp_extract("property", r"^lod(\d)", 1), F.lit(""))
    if lod4_as_lod3:
        lod = F.when(lod == "4", "3").otherwise(lod)
    rows = owned.where("shape is not null").withColumns({
        "gpath": F.slice("path", F.lit(1), F.col("shape") + 1), "property": _local(F.get("names", F.col("owner") + 1)), "gtype": kind[_local(F.get("names", F.col("shape")))]})
    key = ["file", "nr", "objectid", "gpath", "property", "gtype"]
    every = rows.select(*key).distinct()
    # coordinates of rings, in document order
    last = _local(F.get("names", F.col("here")))
    prim = F.greatest(F.coalesce(_last_of(_PRIMITIVES), F.col("shape")), F.col("shape"))
    numbers = F.split("text", r"\s+").cast("array<double>")
    coordinates = rows.where(last.isin("pos", "posList") & F.col("text").isNotNull() & ~F.col("text").rlike(r"[^-+.0-9eE\s]")).withColumns({"prim": prim, "ring": F.coalesce(_last_of(_RINGS), prim)})
    cut = coordinates.select(
        *key, "path", "dim", numbers.alias("numbers"), F.slice("path", F.lit(1), F.col("prim") + 1).alias("prim"), F.get("ids", F.col("prim")).alias("object_id"),
        F.array_compact(F.slice("ids", F.col("shape") + 1, F.col("prim") - F.col("shape") + 1)).alias("within"),
        F.slice("path", F.lit(1), F.col("ring") + 1).alias("ring"), (_local(F.get("names", F.col("ring") - 1)) == "interior").alias("hole"))
    rings = cut.groupBy(*key, "prim", "object_id", "within", "hole", "ring").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "numbers"))), lambda x: x["numbers"])).alias("numbers"), F.max("dim").alias("dim"))
    starts = F.when(F.size("numbers") >= F.col("dim"), F.sequence(F.lit(1), F.size("numbers") - F.col("dim") + 1, F.col("dim"))).otherwise(F.array().cast("array<int>"))
    points = F.transform(starts, lambda i: F.slice("numbers", i, F.col("dim")))
    rings = rings.withColumn("points", points).where("size(points) > 0")
    prims = checkpointed(rings.groupBy(*key, "prim", "object_id", "within").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "points"))), lambda x: x["points"]).alias("rings")))
    # what stands in the file under an id, and where it is wanted
    named = prims.select("file", F.explode(F.array_distinct("within")).alias("href"), F.struct("prim", "object_id", "rings").alias("p")).groupBy("file", "href").agg(
        F.array_sort(F.collect_list("p")).alias("found"))
    wanted = rows.where(F.col("attributes")["xlink:href"].startswith("#")).select(*key, F.col("path").alias("place"), F.substring(F.col("attributes")["xlink:href"], 2, 1 << 20).alias("href"))
    met = wanted.join(named, ["file", "href"], "left")
    own = prims.select(*key, F.col("prim").alias("place"), F.lit(0).alias("nth"), "object_id", "rings")
    more = met.where("found is not null").select(*key, "place", F.posexplode("found").alias("nth", "p")).select(*key, "place", "nth", "p.object_id", "p.rings")
    parts = own.unionByName(more).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "nth", "object_id", "rings"))), lambda x: F.struct(
        x["object_id"].alias("object_id"), x["rings"].alias("rings"))).alias("parts"))
    gone = met.where("found is null").groupBy(*key).agg(F.count("*").alias("lost"))
    shapes = every.join(parts, key, "left").join(gone, key, "left").withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
    node = lambda type_, parent, index, name: F.struct(
        type_.cast("int").alias("type"), name.cast("string").alias("object_id"), parent.cast("int").alias("parent"),
        index.cast("int").alias("geometry_index"), F.lit(None).cast("boolean").alias("is_reversed"))
    none, code = F.lit(None), F.col("gtype")
    leaf = F.when(code <= 2, 1).when(code <= 4, 3).otherwise(5)
    nodes = F.when(code.isin(1, 3, 5), F.array(node(code, none, F.lit(0), F.get("parts", 0)["object_id"]))).otherwise(
        F.concat(F.array(node(code, none, none, none)), F.transform("parts", lambda p, i: node(leaf, F.lit(0), i, p["object_id"]))))
    shape = F.struct(F.col("gpath"), F.struct(lod.alias("lod"), code.alias("geometry_type"), nodes.alias("nodes"), F.transform("parts", lambda p: p["rings"]).alias("primitives")).alias("g"))
    bad = (F.size("parts") == 0) | F.col("lost").isNotNull()
    return shapes.groupBy("file", "nr", "objectid").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.size("parts") > 0, shape))), lambda x: x["g"]).alias("geometries"),
        F.sort_array(F.collect_list(F.when(bad, F.col("property")))).alias("unreadable"))


# -- writing

_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escaped(text: Column) -> Column:
    for plain, escape in _XML:
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def _element(name: Column | str, content: Column, attributes: Column | str = "") -> Column:
    name, attributes = (F.lit(x) if isinstance(x, str) else x for x in (name, attributes))
    return F.concat(F.lit("<"), name, attributes, F.lit(">"), content, F.lit("</"), name, F.lit(">"))


def _gml() -> Column:
    """The GML of a row with ``geometry_type``, ``nodes`` and ``primitives``; polygons keep their ids."""
    code = F.col("geometry_type")
    numbers = lambda points: F.array_join(F.flatten(points).cast("array<string>"), " ")
    pos = lambda points: _element("gml:posList", numbers(points))
    ring = lambda points, i: _element(F.when(i == 0, "gml:exterior").otherwise("gml:interior"), _element("gml:LinearRing", pos(points)))
    names = F.map_from_entries(F.transform(F.filter("nodes", lambda n: n["geometry_index"].isNotNull()), lambda n: F.struct(n["geometry_index"], n["object_id"])))
    own = lambda i: F.coalesce(F.concat(F.lit(' gml:id="'), _escaped(names[i]), F.lit('"')), F.lit(""))
    polygons = F.transform("primitives", lambda p, i: _element("gml:Polygon", F.array_join(F.transform(p, ring), ""), own(i)))
    lines = F.transform("primitives", lambda p: _element("gml:LineString", pos(F.get(p, 0))))
    points = F.transform("primitives", lambda p: _element("gml:Point", _element("gml:pos", numbers(F.get(p, 0)))))
    members = lambda items, name: F.array_join(F.transform(items, lambda x: _element(name, x)), "")
    surfaces = members(polygons, "gml:surfaceMember")
    shell = _element("gml:exterior", _element("gml:Shell", surfaces))
    body = (F.when(code == 1, F.get(points, 0)).when(code == 2, _element("gml:MultiPoint", members(points, "gml:pointMember")))
            .when(code == 3, F.get(lines, 0)).when(code == 4, _element("gml:MultiCurve", members(lines, "gml:curveMember"))).when(code == 5, F.get(polygons, 0)))
    for name, number in _GEOMETRY.items():
        if number in (6, 7, 8):
            body = body.when(code == number, _element(f"gml:{name}", surfaces))
        if number == 9:
            body = body.when(code == number, _element(f"gml:{name}", shell))
        if number in (10, 11):
            body = body.when(code == number, _element(f"gml:{name}", _element("gml:solidMember", _element("gml:Solid", shell))))
    flat = F.exists(F.flatten(F.flatten("primitives")), lambda p: F.size(p) == 2)
    return F.when(flat, F.regexp_replace(body, "^<([^ >]+)", '<$1 srsDimension="2"')).otherwise(body)


def citygml_members(m: CityModel, roots: DataFrame, member: str = "core:cityObjectMember") -> tuple[str, DataFrame]:
    """The opening line of a file and one row (root_id, value) per member: each root with all it contains.

    Values become generic attributes by their type, those with nested ones attribute sets, geometries LoD properties, contained features the content of
    a property of that name. A feature that stands elsewhere in the member or outside is given by reference.
    """
    aliases = m.namespace.select(F.col("id").alias("namespace_id"), "alias")
    prefixes = m.objectclass.join(aliases, "namespace_id", "left").select("classname", F.coalesce("alias", F.lit("core")).alias("alias")).collect()  # a row a class
    prefix = F.create_map(*[F.lit(x) for r in prefixes for x in (r["classname"], f"{r['alias']}:{r['classname']}")])
    uris = {r["alias"]: r["namespace"] or f"urn:{r['alias']}" for r in m.namespace.select("alias", "namespace").collect()}  # a row a namespace
    uris = {"core": "http://www.opengis.net/citygml/3.0", "gen": "http://www.opengis.net/citygml/generics/3.0"} | uris | {
        "gml": "http://www.opengis.net/gml/3.2", "xlink": "http://www.w3.org/1999/xlink"}
    head = "<core:CityModel " + " ".join(f'xmlns:{a}="{u}"' for a, u in sorted(uris.items())) + ">"

    def valued(rows: DataFrame) -> DataFrame:
        shapes = m.geometry_data.select(F.col("id").alias("val_geometry_id"), _gml().alias("gml"))
        with_shape = rows.join(shapes, "val_geometry_id", "left")
        typed = [("int", F.col("val_int").cast("string")), ("double", F.col("val_double").cast("string")), ("string", _escaped(F.col("val_string"))),
                 ("date", F.date_format("val_timestamp", "yyyy-MM-dd'T'HH:mm:ss")), ("uri", _escaped(F.col("val_uri"))), ("string", _escaped(F.col("val_array")))]
        called = F.concat(F.lit(' name="'), _escaped(F.col("name")), F.lit('"'))
        uom = F.concat(F.lit(' uom="'), _escaped(F.col("val_uom")), F.lit('"'))
        plain = F.lit(None).cast("string")
        for kind, text in reversed(typed):
            unit = uom if kind == "double" else F.lit(None).cast("string")
            name = F.when(unit.isNotNull(), "gen:measureAttribute").otherwise(f"gen:{kind}Attribute")
            plain = F.when(text.isNotNull(), _element(name, _element("gen:value", text, F.coalesce(unit, F.lit(""))), called)).otherwise(plain)
        shape = _element(F.concat(F.lit("core:lod"), F.coalesce("val_lod", F.lit("")), F.lit("Geometry")), F.col("gml"))
        return with_shape.withColumn("value", F.coalesce(F.when(F.col("gml").isNotNull(), shape), F.when(F.col("val_lod").isNull(), plain)))

    inside = F.array_join("members", "")
    step = F.concat(F.lit("core:"), F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    reference = F.concat(F.lit(' xlink:href="#'), _escaped(F.col("target")), F.lit('"'))
    as_property = (F.when(F.col("feature").isNotNull(), _element(step, F.col("feature"))).when(F.col("target").isNotNull(), _element(step, F.lit(""), reference))
                   .when(F.size("members") > 0, _element("gen:genericAttributeSet", inside, F.concat(F.lit(' name="'), _escaped(F.col("name")), F.lit('"'))))
                   .otherwise(F.coalesce("value", F.lit(""))))
    as_feature = _element(F.coalesce(prefix[F.col("class")], F.concat(F.lit("core:"), F.col("class"))), inside, F.concat(F.lit(' gml:id="'), _escaped(F.col("objectid")), F.lit('"')))
    trees = folded(unfolded(m, roots, valued), as_property, as_feature, "string")
    line = _element(member, F.regexp_replace("tree", r"[\r\n]+", " "))
    return head, trees.select("root_id", line.alias("value"))


def write_citygml(m: CityModel, roots: DataFrame, path: str, files: int | None = None) -> None:
    """Write features with all they contain as CityGML: folders ``file=0 …``, each a document with its head and foot.

    ``files``: how many; as many as the session has shuffle partitions, if not given.
    """
    head, members = citygml_members(m, roots)
    files = files or int(m.spark.conf.get("spark.sql.shuffle.partitions"))
    body = members.select(F.pmod(F.xxhash64("root_id"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("place"), "root_id", "value")
    frame = m.spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("place"), F.lit("</core:CityModel>").alias("value")))).alias("x"))
    frame = frame.select("file", "x.place", F.lit(None).cast("bigint").alias("root_id"), "x.value")
    out = frame.unionByName(body).repartition(files, "file").sortWithinPartitions("file", "place", "root_id")
    out.select("file", "value").write.partitionBy("file").mode("errorifexists").text(path)
