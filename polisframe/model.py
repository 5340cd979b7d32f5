"""The table set, its schemas, and the type registry that resolves class and property names."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

from polisframe.runtime import empty_frame, prepare

ENVELOPE = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"
RINGS = "array<array<array<double>>>"

#: Table name -> schema, listed in dependency order (a table only refers to tables before it).
SCHEMAS = {
    "ade": "id int, name string, description string, version string",
    "database_srs": "srid int, srs_name string",
    "namespace": "id int, alias string, namespace string, ade_id int",
    "datatype": "id int, supertype_id int, typename string, is_abstract int, namespace_id int, schema string",
    "objectclass": "id int, superclass_id int, classname string, is_abstract int, is_toplevel int, "
                   "namespace_id int, tablename string, schema string",
    "codelist": "id bigint, codelist_type string, url string, mime_type string",
    "codelist_entry": "id bigint, codelist_id bigint, code string, definition string",
    "feature": "id bigint, objectclass_id int, objectid string, identifier string, identifier_codespace string, "
               f"envelope {ENVELOPE}, creation_date timestamp, termination_date timestamp, valid_from timestamp, "
               "valid_to timestamp, last_modification_date timestamp, updating_person string, "
               "reason_for_update string, lineage string",
    "geometry_data": "id bigint, feature_id bigint, geometry_type int, "
                     "nodes array<struct<type:int,object_id:string,parent:int,geometry_index:int,"
                     f"is_reversed:boolean>>, primitives array<{RINGS}>",
    "implicit_geometry": "id bigint, objectid string, mime_type string, reference_to_library string, "
                         "relative_geometry_id bigint",
    "address": "id bigint, objectid string, street string, house_number string, po_box string, zip_code string, "
               "city string, state string, country string, free_text string, multi_point array<array<double>>, "
               "content string",
    "appearance": "id bigint, objectid string, theme string, feature_id bigint, implicit_geometry_id bigint",
    "tex_image": "id bigint, image_uri string, mime_type string",
    "surface_data": "id bigint, objectid string, objectclass_id int, tex_image_id bigint, is_front int, "
                    "gt_orientation array<double>, gt_reference_point array<double>",
    "surface_data_mapping": "surface_data_id bigint, geometry_data_id bigint, material_mapping string, "
                            "texture_mapping string, world_to_texture_mapping string, "
                            "georeferenced_texture_mapping string",
    "appear_to_surface_data": "id bigint, appearance_id bigint, surface_data_id bigint",
    "property": "id bigint, feature_id bigint, parent_id bigint, datatype_id int, namespace_id int, name string, "
                "val_int bigint, val_double double, val_string string, val_timestamp timestamp, val_uri string, "
                "val_codespace string, val_uom string, val_array string, val_lod string, val_geometry_id bigint, "
                "val_implicitgeom_id bigint, val_implicitgeom_refpoint array<double>, val_appearance_id bigint, "
                "val_address_id bigint, val_feature_id bigint, val_relation_type int, val_content string, "
                "val_content_mime_type string",
    "feature_changelog": "id bigint, feature_id bigint, objectclass_id int, objectid string, identifier string, "
                         f"envelope {ENVELOPE}, transaction_type string, transaction_date timestamp, "
                         "db_user string, reason_for_update string",
}

RELATES, CONTAINS = 0, 1

# Geometry type codes (fixed values of the data model).
POINT, MULTI_POINT, LINE_STRING, MULTI_LINE_STRING, POLYGON = 1, 2, 3, 4, 5
COMPOSITE_SURFACE, TRIANGULATED_SURFACE, MULTI_SURFACE = 6, 7, 8
SOLID, COMPOSITE_SOLID, MULTI_SOLID = 9, 10, 11
GEOMETRY_NAMES = {
    1: "Point", 2: "MultiPoint", 3: "LineString", 4: "MultiLineString", 5: "Polygon", 6: "CompositeSurface",
    7: "TriangulatedSurface", 8: "MultiSurface", 9: "Solid", 10: "CompositeSolid", 11: "MultiSolid",
}


class ModelError(ValueError):
    """A name, type or operand that the model does not know or does not allow."""


@dataclass
class CityModel:
    """The tables of one city model as DataFrames; a table not given is empty.

    A table may be given as a function without arguments, which is called when the table is first used.
    """

    spark: SparkSession
    tables: dict = field(default_factory=dict)
    _registry: "TypeRegistry | None" = None

    def __post_init__(self):
        prepare(self.spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = empty_frame(self.spark, SCHEMAS[name])
        elif not isinstance(self.tables[name], DataFrame):
            self.tables[name] = self.tables[name]()
        return self.tables[name]

    def replace(self, **tables: DataFrame) -> "CityModel":
        """A model with some tables exchanged; this one is left as it is."""
        return CityModel(self.spark, {**self.tables, **tables}, self.types if self.tables else None)

    def select_ids(self, statement: str) -> DataFrame:
        """The result of a one-column SELECT over the model's tables, as the frame ``id``.

        The statement is read as a sub-query, so anything but a query fails before it can run; the tables' names are
        views only while it is analysed, and views of the session with such a name are put back.
        """
        catalog, before = self.spark.catalog, {}
        named = [n for n in self.tables if re.search(rf"\b{n}\b", statement)]
        for name in named:
            if any(t.isTemporary for t in catalog.listTables(pattern=name)):
                before[name] = self.spark.table(name)
        try:
            for name in named:
                self.table(name).createOrReplaceTempView(name)
            ids = self.spark.sql(f"SELECT * FROM (\n{statement}\n)")
        finally:
            for name in named:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    catalog.dropTempView(name)
        if len(ids.columns) != 1:
            raise ModelError("the SQL filter must return one column")
        return ids.toDF("id")

    @property
    def types(self) -> "TypeRegistry":
        if self._registry is None:
            self._registry = TypeRegistry.of(self)
        return self._registry


# value kind -> (property column, comparison type)
VALUE_COLUMNS = {
    "Boolean": ("val_int", "boolean"),
    "Integer": ("val_int", "integer"),
    "Double": ("val_double", "double"),
    "Measure": ("val_double", "double"),
    "String": ("val_string", "string"),
    "Code": ("val_string", "string"),
    "URI": ("val_uri", "string"),
    "Reference": ("val_uri", "string"),
    "Timestamp": ("val_timestamp", "timestamp"),
    "FeatureProperty": ("val_feature_id", "feature"),
    "GeometryProperty": ("val_geometry_id", "geometry"),
    "ImplicitGeometryProperty": ("val_implicitgeom_id", "implicit_geometry"),
    "AddressProperty": ("val_address_id", "feature"),
    "AppearanceProperty": ("val_appearance_id", "feature"),
}

#: ``::`` casts allowed on generic attributes.
CASTS = {
    "bool": "Boolean", "int": "Integer", "double": "Double", "string": "String", "timestamp": "Timestamp",
    "uri": "URI", "code": "Code", "measure": "Measure", "geometry": "GeometryProperty",
    "implicitGeometry": "ImplicitGeometryProperty", "feature": "FeatureProperty",
}


@dataclass(frozen=True)
class PropertyDef:
    """A declared property: where its rows are and what its value is."""

    name: str
    namespace_id: int
    type: str
    target: str | None = None


class TypeRegistry:
    """Class and data type lookups. Both tables are catalogue rows (one per class), so they are read once."""

    def __init__(self, classes: list[dict], datatypes: list[dict], namespaces: list[dict]):
        self.classes = {c["id"]: c for c in classes}
        self.datatypes = {d["id"]: d for d in datatypes}
        self.namespaces = {n["alias"]: n["id"] for n in namespaces}
        self.aliases = {n["id"]: n["alias"] for n in namespaces}
        self._by_typename = {d["typename"]: d for d in datatypes}

    @classmethod
    def of(cls, model: CityModel) -> "TypeRegistry":
        rows = lambda name: [r.asDict() for r in model.table(name).collect()]
        return cls(rows("objectclass"), rows("datatype"), rows("namespace"))

    # -- classes

    def lookup(self, name: str | int) -> dict:
        """A class by id, by ``prefix:Name``, or by local name without regard to case."""
        if isinstance(name, int):
            if name in self.classes:
                return self.classes[name]
            raise ModelError(f"unknown feature type {name}")
        prefix, _, local = name.rpartition(":")
        for c in self.classes.values():
            if prefix:
                if c["classname"] == local and self.aliases.get(c["namespace_id"]) == prefix:
                    return c
            elif c["classname"].lower() == local.lower():
                return c
        raise ModelError(f"unknown feature type {name!r}")

    def ancestors(self, name: str | int) -> list[dict]:
        """The class itself, its superclass, and so on up to the root."""
        chain, current = [], self.lookup(name)
        while current is not None:
            chain.append(current)
            current = self.classes.get(current["superclass_id"])
        return chain

    def subtypes(self, name: str | int) -> list[dict]:
        """All classes that have ``name`` among their ancestors, itself included."""
        top = self.lookup(name)["id"]
        return [c for c in self.classes.values() if top in (a["id"] for a in self.ancestors(c["id"]))]

    def concrete(self, name: str | int) -> list[dict]:
        """An abstract class expands to its concrete subtypes; a concrete class is only itself."""
        c = self.lookup(name)
        return [s for s in self.subtypes(c["id"]) if not s["is_abstract"]] if c["is_abstract"] else [c]

    def feature_class_ids(self, names: Iterable[str | int] | None = None) -> list[int]:
        """Class ids a query on ``names`` selects; without names, all top-level classes."""
        if names is None:
            return sorted(c["id"] for c in self.classes.values()
                          if c["is_toplevel"] and not c["is_abstract"] and c["tablename"] == "feature")
        ids = set()
        for name in names:
            c = self.lookup(name)
            if c["tablename"] != "feature":
                raise ModelError(f"{c['classname']} is not stored as a feature")
            ids |= {s["id"] for s in self.concrete(c["id"]) if s["tablename"] == "feature"}
        return sorted(ids)

    def common_supertype(self, names: Iterable[str | int]) -> dict:
        """The nearest class that all given classes are or derive from."""
        chains = [self.ancestors(n) for n in names]
        shared = set.intersection(*({c["id"] for c in chain} for chain in chains))
        for c in chains[0]:
            if c["id"] in shared:
                return c
        raise ModelError("the feature types have no common supertype")

    # -- properties

    def _declared(self, row: dict | None) -> dict[str, PropertyDef]:
        found = {}
        for p in json.loads(row["schema"] or "{}").get("properties", []) if row else []:
            found[p["name"].lower()] = PropertyDef(p["name"], self.namespaces[p["namespace"]], p["type"],
                                                   p.get("target"))
        return found

    def class_property(self, class_name: str | int, name: str) -> PropertyDef | None:
        """A property declared by a class or one of its supertypes."""
        for c in self.ancestors(class_name):
            found = self._declared(c).get(name.lower())
            if found:
                return found
        return None

    def datatype_property(self, typename: str, name: str) -> PropertyDef | None:
        row = self._by_typename.get(typename)
        while row is not None:
            found = self._declared(row).get(name.lower())
            if found:
                return found
            row = self.datatypes.get(row["supertype_id"])
        return None

    def declared(self) -> list[tuple[str, str, int, str]]:
        """(owner, lower-case name, namespace, type) of all declared properties, inherited ones too; an owner is ``class:id`` or ``type:name``."""
        out = []
        for c in self.classes.values():
            found = {}
            for a in self.ancestors(c["id"]):
                found = self._declared(a) | found
            out += [(f"class:{c['id']}", name, p.namespace_id, p.type) for name, p in found.items()]
        for t in self.datatypes.values():
            out += [(f"type:{t['typename']}", name, p.namespace_id, p.type) for name, p in self._declared(t).items()]
        return out

    def datatype_id(self, typename: str) -> int:
        if typename not in self._by_typename:
            raise ModelError(f"unknown data type {typename!r}")
        return self._by_typename[typename]["id"]
