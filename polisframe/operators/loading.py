"""Bulk loading: filters on incoming features, duplicates, keys, references, metadata, and merging into a model."""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.model import CONTAINS, CityModel, ModelError
from polisframe.operators import removal
from polisframe.runtime import checkpointed, local_frame, number_rows, number_rows_any_order, page_rows

KINDS = ("feature", "implicit_geometry", "address", "surface_data", "tex_image")


# -- filters on incoming features

def filter_by_type(df: DataFrame, m: CityModel, types: Iterable[str]) -> DataFrame:
    """Exact class membership, without subtypes; names without prefix match in any case."""
    return df.where(F.col("objectclass_id").isin([m.types.lookup(t)["id"] for t in types]))


def filter_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Features whose objectid is among ``ids`` (a one-column frame)."""
    return df.join(ids.toDF("objectid"), "objectid", "left_semi")


def filter_by_bbox(df: DataFrame, box: tuple[float, ...], mode: str = "intersects") -> DataFrame:
    """``intersects``, ``contains`` (the box contains the feature) or ``on_tile``; no envelope, no match."""
    if mode == "intersects":
        return df.where(env.intersects(env.box(*box), F.col("envelope")))
    if mode == "contains":
        return df.where(env.contains(env.box(*box), F.col("envelope")))
    if mode == "on_tile":
        half = len(box) // 2
        return df.where(env.is_on_tile("envelope", box[0], box[1], box[half], box[half + 1]))
    raise ModelError(f"unknown bbox mode {mode!r}")


def load_limit(df: DataFrame, limit: int, start: int = 0, order: Iterable[str] = ("file", "seq")) -> DataFrame:
    """Skip ``start`` accepted features, take ``limit``, in input order across files."""
    return page_rows(df, [F.col(c) for c in order], limit, start)


def read_id_list(spark: SparkSession, path: str, column: str | int = 0, header: bool = True, delimiter: str = ",",
                 quote: str = '"', escape: str = '"', comment: str | None = None,
                 encoding: str = "UTF-8") -> DataFrame:
    """A CSV of ids as a one-column frame ``id``; the column is an index or a header name in any case."""
    reader = spark.read.options(header=header, sep=delimiter, quote=quote, escape=escape, encoding=encoding,
                                ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if comment is not None:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    if isinstance(column, str):
        found = [c for c in df.columns if c.lower() == column.lower()]
        if not header or not found:
            raise ModelError(f"the id list has no column {column!r}")
        name = found[0]
    elif 0 <= column < len(df.columns):
        name = df.columns[column]
    else:
        raise ModelError(f"the id list has no column {column}")
    return df.select(F.col(f"`{name}`").alias("id")).where("id is not null and trim(id) <> ''")


# -- keys, duplicates, references

def assign_ids(df: DataFrame, start: int = 1, order: list[Column] | None = None, name: str = "id") -> DataFrame:
    """Consecutive surrogate keys from ``start``: in partition order, or in a given total order."""
    if order:
        return number_rows(df, order, name, start)
    return number_rows_any_order(df, name, start)


def dedupe_objects(df: DataFrame, keys: Iterable[str] = ("kind", "objectid"), order: str = "seq") -> DataFrame:
    """Mark repeated object ids of one load: ``is_reference`` is false for the first in ``order``, true afterwards.

    Rows without an object id are objects of their own. The first is found by a partial aggregate, so one id with very
    many copies costs one row per task.
    """
    keys = list(keys)
    named, unnamed = df.where(F.col(keys[-1]).isNotNull()), df.where(F.col(keys[-1]).isNull())
    first = named.groupBy(*keys).agg(F.min(order).alias("_first"))
    marked = named.join(first, keys).withColumn("is_reference", F.col(order) != F.col("_first")).drop("_first")
    return marked.unionByName(unnamed.withColumn("is_reference", F.lit(False)))


def resolve_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``target_id`` to (kind, objectid) references; of several targets with one object id the largest id wins."""
    keys = ["kind", "objectid"]
    one = targets.groupBy(*keys).agg(F.max("id").alias("target_id"))
    named = refs.where("objectid is not null").join(one, keys, "left")
    unnamed = refs.where("objectid is null").withColumn("target_id", F.lit(None).cast("bigint"))
    return named.unionByName(unnamed)


def unresolved_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (kind, objectid) without a target; texture images are not reported."""
    return refs.where("objectid is not null and kind <> 'tex_image'").select("kind", "objectid").distinct().join(
        targets, ["kind", "objectid"], "left_anti")


def find_duplicates(incoming: DataFrame, m: CityModel) -> DataFrame:
    """(objectid, id) of incoming object ids that are in the model and not terminated."""
    stored = m.feature.where("termination_date is null").select("objectid", "id")
    return stored.join(incoming.select("objectid"), "objectid", "left_semi")


# -- metadata

def apply_metadata(df: DataFrame, now: Column, creation_date_mode: str = "attribute", creation_date: Column | None = None,
                   person: str | None = None, reason: str | None = None, lineage: Column | str | None = None) -> DataFrame:
    """Bookkeeping columns: creation date by mode (attribute or now / fixed / now), the others where absent.

    ``now`` is the one load timestamp.
    """
    now = now.cast("timestamp")
    if creation_date_mode == "fixed":
        created = creation_date.cast("timestamp") if creation_date is not None else now
    elif creation_date_mode == "now":
        created = now
    elif creation_date_mode == "attribute":
        created = F.coalesce("creation_date", now)
    else:
        raise ModelError(f"unknown creation date mode {creation_date_mode!r}")
    out = df.withColumn("creation_date", created).withColumn(
        "last_modification_date", F.coalesce("last_modification_date", now))
    for name, value in (("updating_person", person), ("reason_for_update", reason), ("lineage", lineage)):
        if value is not None:
            out = out.withColumn(name, F.coalesce(name, value if isinstance(value, Column) else F.lit(value)))
    return out


_FILE_TOKEN = re.compile(r"@((?:file|content)_(?:path|name|base_name))@", re.IGNORECASE)


def lineage_from_file(template: str, path: Column) -> Column:
    """Replace ``@file_path@``, ``@file_name@``, ``@file_base_name@`` and their ``content_`` twins by parts of a path."""
    path = F.regexp_replace(path, "^file:/*", "/")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    parts = {"path": path, "name": name, "base_name": F.regexp_replace(name, r"\.[^.]*$", "")}
    out, last = [], 0
    for match in _FILE_TOKEN.finditer(template):
        out += [F.lit(template[last:match.start()]), parts[match.group(1).lower().split("_", 1)[1]]]
        last = match.end()
    return F.concat(*out, F.lit(template[last:]))


# -- shredding

def shred(objects: DataFrame, m: CityModel, start_id: int = 1, property_start: int = 1, geometry_start: int = 1, template_start: int = 1,
          templates: DataFrame | None = None) -> CityModel:
    """City objects to feature, property and geometry rows with new keys, from a start per table (``next_ids`` of the
    model that the result is merged into).

    ``objects`` has: file, seq, objectid, parent_objectid (null at the top), objectclass_id, envelope, attributes
    (VARIANT object), geometries (array of struct lod, geometry_type, nodes, primitives), and maybe units (map of attribute
    names to units of measure) and parent_property (the name that the parent holds it under). Attributes become one property row each, of the type and namespace
    that the class or a supertype declares, else generic by their look; objects inside attributes become nested rows under their parent's id, level by level. A repeated
    object id becomes a reference to its first occurrence. ``templates`` (template_key, geometry_type, nodes, primitives) are the shapes that
    ``placements`` of the objects (lod, template_key, matrix, reference_point) put somewhere; equal keys, from whatever file, are one template.
    """
    marked = dedupe_objects(objects.withColumn("kind", F.lit("feature")), ("kind", "objectid"), "seq").drop("kind")
    keyed = assign_ids(marked.where("not is_reference").drop("is_reference"), start_id, name="id")
    feature = keyed.select("id", "objectclass_id", "objectid", "envelope")

    held_by = F.col("parent_property") if "parent_property" in marked.columns else F.lit(None).cast("string")
    edges = marked.where("parent_objectid is not null").select("parent_objectid", "objectid", "is_reference", held_by.alias("held_by"))
    ids = keyed.select("id", "objectid")
    declared = local_frame(m.spark, m.types.declared(), "owner string, _name string, declared_namespace int, declared string")
    parents = keyed.select(F.col("id").alias("feature_id"), F.col("objectid").alias("parent_objectid"), F.concat(F.lit("class:"), "objectclass_id").alias("owner"))
    edges = edges.join(parents, "parent_objectid").withColumn("_name", F.lower("held_by")).join(declared, ["owner", "_name"], "left")
    edges = edges.join(ids.withColumnRenamed("id", "val_feature_id"), "objectid")
    relation = F.when(F.col("is_reference"), 0).otherwise(CONTAINS)
    child = _property_row(edges, name=F.coalesce("held_by", F.lit("child")), datatype=F.lit("FeatureProperty"), namespace=F.coalesce("declared_namespace", F.lit(1)),
                          val_feature_id=F.col("val_feature_id"), val_relation_type=relation)

    shapes = keyed.select(F.col("id").alias("feature_id"), F.explode("geometries").alias("g")).select(
        "feature_id", "g.*")
    shapes = assign_ids(shapes, geometry_start, name="geometry_id")
    geometry = shapes.select(F.col("geometry_id").alias("id"), "feature_id", "geometry_type", "nodes", "primitives")
    shape_rows = _property_row(shapes, name=F.concat(F.lit("lod"), F.coalesce("lod", F.lit("")), F.lit("Geometry")),
                               datatype=F.lit("GeometryProperty"), namespace=1, val_lod=F.col("lod"),
                               val_geometry_id=F.col("geometry_id"))

    plain = child.unionByName(shape_rows)
    implicit = m.implicit_geometry
    if templates is not None:
        once = templates.groupBy("template_key").agg(*[F.first(c).alias(c) for c in ("geometry_type", "nodes", "primitives")])
        once = assign_ids(assign_ids(once, template_start, [F.col("template_key")], "template_id"), _next_id(geometry, geometry_start), [F.col("template_key")], "geometry_id")
        implicit = once.select(F.col("template_id").alias("id"), F.col("template_key").alias("objectid"), F.col("geometry_id").alias("relative_geometry_id"))
        placed = keyed.where("placements is not null").select(F.col("id").alias("feature_id"), F.explode("placements").alias("p")).select("feature_id", "p.*").join(
            once.select("template_key", "template_id"), "template_key")
        plain = plain.unionByName(_property_row(
            placed, name=F.concat(F.lit("lod"), F.coalesce("lod", F.lit("")), F.lit("ImplicitRepresentation")), datatype=F.lit("ImplicitGeometryProperty"), namespace=1, val_lod=F.col("lod"),
            val_implicitgeom_id=F.col("template_id"), val_array=F.to_json("matrix"), val_implicitgeom_refpoint=F.col("reference_point")))
        geometry = geometry.unionByName(once.select(F.col("geometry_id").alias("id"), F.lit(None).cast("bigint").alias("feature_id"), "geometry_type", "nodes", "primitives"))
    units = F.col("units") if "units" in keyed.columns else F.lit(None).cast("map<string,string>")
    level = keyed.where("attributes is not null").select(
        F.col("id").alias("feature_id"), F.lit(None).cast("bigint").alias("parent_id"), "attributes", units.alias("units"), F.concat(F.lit("class:"), "objectclass_id").alias("owner"))
    properties = assign_ids(plain, property_start)
    next_id = _next_id(properties, property_start)
    while True:
        spark = level.sparkSession
        entries = level.lateralJoin(spark.tvf.variant_explode(F.col("attributes").outer())).select(
            "feature_id", "parent_id", "owner", F.col("key").alias("name"), "value", F.col("units")[F.col("key")].alias("uom"))
        entries = entries.withColumn("_name", F.lower("name")).join(declared, ["owner", "_name"], "left").drop("owner", "_name")
        entries = entries.where("not is_variant_null(value)").withColumn("shape", F.schema_of_variant("value"))
        # a declared property with several values has a row for each
        several = F.col("declared").isNotNull() & F.col("shape").startswith("ARRAY")
        each = entries.where(several).withColumnRenamed("value", "list").lateralJoin(spark.tvf.variant_explode(F.col("list").outer())).drop("list", "pos", "key", "shape")
        each = each.where("not is_variant_null(value)").withColumn("shape", F.schema_of_variant("value"))
        entries = entries.where(~several).unionByName(each)
        numbered = assign_ids(entries, next_id)
        if numbered.isEmpty():
            break
        properties = properties.unionByName(_attribute_rows(numbered))
        next_id = _next_id(numbered, next_id)
        level = numbered.where("shape like 'OBJECT%'").select(
            "feature_id", F.col("id").alias("parent_id"), F.col("value").alias("attributes"),
            F.when(F.col("uom").isNotNull(), F.create_map(F.lit("value"), "uom", F.lit("area"), "uom", F.lit("volume"), "uom")).alias("units"),
            F.concat(F.lit("type:"), F.coalesce("declared", F.lit(""))).alias("owner"))
    types = m.datatype.select(F.col("id").alias("datatype_id"), F.col("typename").alias("datatype"))
    properties = properties.join(types, "datatype", "left").drop("datatype")
    return m.replace(feature=_conform(feature, m.feature), property=_conform(properties, m.property),
                     geometry_data=_conform(geometry, m.geometry_data), implicit_geometry=_conform(implicit, m.implicit_geometry))


def next_ids(m: CityModel) -> dict[str, int]:
    """The first free keys of a model, as the arguments of ``shred``."""
    return {"start_id": _next_id(m.feature, 1), "property_start": _next_id(m.property, 1), "geometry_start": _next_id(m.geometry_data, 1),
            "template_start": _next_id(m.implicit_geometry, 1)}


def _next_id(numbered: DataFrame, start: int) -> int:
    top = numbered.agg(F.max("id")).first()[0]
    return start if top is None else top + 1


_VALUES = {"val_timestamp": "timestamp", "val_uri": "string", "val_int": "bigint", "val_double": "double", "val_string": "string", "val_array": "string",
           "val_uom": "string", "val_lod": "string", "val_geometry_id": "bigint", "val_feature_id": "bigint", "val_relation_type": "int",
           "parent_id": "bigint", "val_implicitgeom_id": "bigint", "val_implicitgeom_refpoint": "array<double>"}


def _property_row(df: DataFrame, name: Column, datatype: Column, namespace: int | Column, **values: Column) -> DataFrame:
    columns = [(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in _VALUES.items()]
    keep = ["id"] if "id" in df.columns else []
    return df.select(*keep, "feature_id", name.alias("name"), datatype.alias("datatype"),
                     (namespace if isinstance(namespace, Column) else F.lit(namespace)).cast("int").alias("namespace_id"), *columns)


def _attribute_rows(df: DataFrame) -> DataFrame:
    """Attribute entries with their value in the column of its type: the declared one, else the one it looks like."""
    shape, known = F.col("shape"), F.col("declared")
    get = lambda t: F.try_variant_get("value", "$", t)
    text = get("string")
    whole, real = shape == "BIGINT", shape.startswith("DECIMAL") | (shape == "DOUBLE") | (shape == "FLOAT")
    flag, many, nested = shape == "BOOLEAN", shape.startswith("ARRAY"), shape.startswith("OBJECT")
    guess = (F.when(F.col("uom").isNotNull() & (whole | real), "Measure").when(whole, "Integer").when(real, "Double")
             .when(flag, "Boolean").when(many, "StringOrRef").when(nested, "GenericAttributeSet").otherwise("String"))
    plain = known.isin("Integer", "Boolean", "Double", "Measure", "String", "Code", "URI", "Reference", "Timestamp") & ~nested & ~many
    kind = F.when(plain, known).when(known.isNotNull() & nested, known).otherwise(guess)
    truth = F.coalesce(get("boolean").cast("int"), text.try_cast("boolean").cast("int"))
    return _property_row(
        df, F.col("name"), kind, F.coalesce("declared_namespace", F.lit(3)), parent_id=F.col("parent_id"),
        val_int=F.when(kind == "Integer", F.coalesce(get("bigint"), text.try_cast("bigint"))).when(kind == "Boolean", truth),
        val_double=F.when(kind.isin("Double", "Measure"), F.coalesce(get("double"), text.try_cast("double"))), val_uom=F.col("uom"),
        val_string=F.when(kind.isin("String", "Code") & ~many & ~nested, text), val_uri=F.when(kind.isin("URI", "Reference"), text),
        val_timestamp=F.when(kind == "Timestamp", text.try_cast("timestamp")), val_array=F.when(many, F.to_json("value")))


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns and types of ``like``; nulls for those the frame lacks."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


# -- merging

def merge_load(m: CityModel, incoming: CityModel, mode: str, now: Column, preview: bool = False,
               ) -> tuple[CityModel, DataFrame]:
    """Add an incoming model (keys already disjoint) and return the new model and one row of counts.

    ``import_all`` adds everything; ``skip`` drops incoming features that are in the model and not terminated, with
    what only they contain or own; ``delete`` and ``terminate`` first do that to the stored duplicates.
    """
    top = incoming.feature.where(F.col("objectclass_id").isin(m.types.feature_class_ids()))
    duplicates = find_duplicates(top, m)
    if mode in ("skip", "delete", "terminate"):
        duplicates = checkpointed(duplicates)
    base, added = m, incoming
    if mode == "skip":
        known = top.join(duplicates.select("objectid"), "objectid", "left_semi").select("id")
        # what only they own goes as well: sub-features, appearances with their surface data, addresses
        added, _ = removal.delete(incoming, known)
    elif mode == "delete":
        base, _ = removal.delete(m, duplicates.select("id"), preview)
    elif mode == "terminate":
        base, _ = removal.terminate(m, duplicates.select("id"), now, preview=preview)
    elif mode != "import_all":
        raise ModelError(f"unknown import mode {mode!r}")
    tally = lambda df, d, a: df.select(F.lit(d).alias("duplicates"), F.lit(a).alias("added"))
    counts = tally(duplicates, 1, 0).unionByName(tally(added.feature, 0, 1)).agg(
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"))
    if preview:
        return m, counts
    merged = {}
    for table in ("feature", "property", "geometry_data", "implicit_geometry", "address", "appearance", "tex_image",
                  "surface_data", "surface_data_mapping", "appear_to_surface_data"):
        if table in incoming.tables:
            merged[table] = base.table(table).unionByName(_conform(added.table(table), base.table(table)))
    return base.replace(**merged), counts


def load_hook(features: DataFrame, hook) -> DataFrame:
    """Apply a user function to the features; returning null keys drops a feature. The hook maps frame to frame."""
    return features.transform(hook).where("objectid is not null")
