"""A city model derived from the bundled trade tables (rules in FIXTURES.md, section 3).

All keys and coordinates come from integer arithmetic on the source keys, so the model is the same on every engine and
grows with its inputs. Each property name is its own branch of a union: a filter on ``name`` leaves only the scans it
needs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.model import CONTAINS, RELATES, SCHEMAS, CityModel
from polisframe.runtime import local_frame, prepare

NAMESPACES = [(1, "core", "http://example.org/core", None), (2, "own", "http://example.org/own", 1),
              (3, "gen", "http://example.org/generics", None)]

# id, supertype, name, namespace, declared properties
_DATATYPES = [
    (1, None, "Boolean", 1, None), (2, None, "Integer", 1, None), (3, None, "Double", 1, None),
    (4, None, "String", 1, None), (5, None, "URI", 1, None), (6, None, "Timestamp", 1, None),
    (7, None, "Code", 1, None), (8, None, "Measure", 1, None), (9, None, "FeatureProperty", 1, None),
    (10, None, "GeometryProperty", 1, None), (11, None, "ImplicitGeometryProperty", 1, None),
    (12, None, "AddressProperty", 1, None), (13, None, "AppearanceProperty", 1, None),
    (14, None, "Reference", 1, None),
    (20, None, "Dims", 2, [("size", "own", "Integer"), ("type", "own", "String")]),
]
DATATYPE_IDS = {name: id_ for id_, _, name, _, _ in _DATATYPES}

# id, superclass, name, abstract, top level, table, declared properties
_CLASSES = [
    (1, None, "AbstractObject", 1, 0, "feature",
     [("geometry", "own", "GeometryProperty"), ("shape", "own", "ImplicitGeometryProperty"),
      ("boundary", "core", "FeatureProperty", "AbstractObject")]),
    (2, 1, "AbstractParty", 1, 0, "feature", [("balance", "own", "Double"), ("nation", "own", "Integer")]),
    (3, 1, "AbstractTransaction", 1, 0, "feature", [("item", "own", "FeatureProperty", "OrderItem")]),
    (10, 2, "Customer", 0, 1, "feature",
     [("segment", "own", "Code"), ("order", "own", "FeatureProperty", "Order"),
      ("address", "core", "AddressProperty")]),
    (11, 2, "Supplier", 0, 1, "feature", []),
    (20, 3, "Order", 0, 1, "feature", [("priority", "own", "Code"), ("price", "own", "Measure")]),
    (21, 3, "OrderItem", 0, 0, "feature",
     [("quantity", "own", "Double"), ("supplier", "own", "FeatureProperty", "Supplier")]),
    (22, 3, "ItemDetail", 0, 0, "feature", []),
    (30, 1, "Part", 0, 1, "feature", [("dims", "own", "Dims")]),
    (40, 1, "AbstractSurfaceData", 1, 0, "surface_data", []),
    (41, 40, "X3DMaterial", 0, 0, "surface_data", []),
    (42, 40, "ParameterizedTexture", 0, 0, "surface_data", []),
    (43, 40, "GeoreferencedTexture", 0, 0, "surface_data", []),
    (50, 1, "Address", 0, 0, "address", []),
]


def _schema_doc(properties) -> str | None:
    if not properties:
        return None
    keys = ("name", "namespace", "type", "target")
    return json.dumps({"properties": [dict(zip(keys, p)) for p in properties]})


def city_model(spark: SparkSession, sf_dir: str) -> CityModel:
    """The whole derived model, lazily: nothing is read until a table is used.

    The plans of one session and folder are built once and shared; they hold no data.
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = _build(prepare(spark), sf_dir)
    return _MODELS[key]


_MODELS: dict[tuple, CityModel] = {}


def _build(spark: SparkSession, sf_dir: str) -> CityModel:
    source = _Source(spark, sf_dir)
    frame = lambda rows, name: lambda: local_frame(spark, rows, SCHEMAS[name])
    return CityModel(spark, {
        "ade": frame([(1, "trade", "Trade objects", "1.0")], "ade"),
        "namespace": frame(NAMESPACES, "namespace"),
        "datatype": frame([(i, s, n, 0, ns, _schema_doc(p)) for i, s, n, ns, p in _DATATYPES], "datatype"),
        "objectclass": frame([(i, s, n, a, t, 2, tab, _schema_doc(p)) for i, s, n, a, t, tab, p in _CLASSES],
                             "objectclass"),
        **{name: getattr(source, name) for name in (
            "codelist", "codelist_entry", "feature", "property", "geometry_data", "implicit_geometry", "address",
            "appearance", "tex_image", "surface_data", "surface_data_mapping", "appear_to_surface_data",
            "feature_changelog")},
    })


def order_id(key: str) -> Column:
    return F.col(key) * 64


def item_id() -> Column:
    return F.col("l_orderkey") * 64 + 1 + F.col("l_linenumber")


def detail_id() -> Column:
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return F.col("l_orderkey") * 64 + 16 + F.col("l_linenumber") * 4 + flag


def customer_id(key: str) -> Column:
    return F.col(key) * 64 + 60


def supplier_id(key: str) -> Column:
    return F.col(key) * 64 + 61


def part_id(key: str) -> Column:
    return F.col(key) * 64 + 62


def box(k: Column, shift: Column | int = 0, size_x: int = 1009, size_y: int = 997, block: int = 200_000,
        flat: Column | None = None) -> Column:
    """Envelope of key ``k``: pseudo-random inside a block, one more block in x for every ``block`` keys."""
    rx, ry = k % size_x, k % size_y
    xmin = (rx * rx * 31 + rx * 7919) % size_x + F.floor(k / block) * size_x + shift
    ymin = (ry * ry * 17 + ry * 104729) % size_y
    two_d = (k % 4 == 0) if flat is None else flat
    d = lambda c: c.cast("double")
    return F.struct(
        d(xmin).alias("xmin"), d(ymin).alias("ymin"), F.when(~two_d, F.lit(0.0)).alias("zmin"),
        d(xmin + 1 + k % 5).alias("xmax"), d(ymin + 1 + k % 3).alias("ymax"),
        F.when(~two_d, d(3 + k % 10)).alias("zmax"),
    )


def _fill(df: DataFrame, table: str, **columns: Column) -> DataFrame:
    """Select a table's columns in schema order, nulls for those not given."""
    types = dict(part.strip().split(" ", 1) for part in _split_schema(SCHEMAS[table]))
    given = df.select(*[c.alias(f"_{n}") for n, c in columns.items()])
    return given.selectExpr(*[
        f"cast({f'_{n}' if n in columns else 'null'} as {t}) as {n}" for n, t in types.items()
    ])


def _split_schema(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return parts + [ddl[start:]]


class _Source:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.orders = self._read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
        self.lineitem = self._read("lineitem")
        self.customer, self.supplier, self.part = (self._read(n) for n in ("customer", "supplier", "part"))
        self.items = self.lineitem.select("l_orderkey", "l_linenumber").distinct()
        self.details = self.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()

    # -- feature

    def feature(self) -> DataFrame:
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        c = F.col
        dated = self.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
        branches = [
            self._transaction(dated, 20, order_id("o_orderkey"), text("O_", c("o_orderkey")),
                              box(c("o_orderkey"))),
            self._transaction(
                self.items.join(dated, c("l_orderkey") == c("o_orderkey")), 21, item_id(),
                text("I_", c("l_orderkey"), "_", c("l_linenumber")), box(c("l_orderkey"), c("l_linenumber"))),
            self._transaction(
                self.details.join(dated, c("l_orderkey") == c("o_orderkey")), 22, detail_id(),
                text("D_", c("l_orderkey"), "_", c("l_linenumber"), "_", c("l_returnflag")),
                box(c("l_orderkey"), c("l_linenumber"))),
            self._other(self.customer, 10, "c_custkey", customer_id("c_custkey"), "C_",
                        c("c_custkey") % 10 != 0),
            self._other(self.supplier, 11, "s_suppkey", supplier_id("s_suppkey"), "S_", F.lit(True)),
            self._other(self.part, 30, "p_partkey", part_id("p_partkey"), "P_", F.lit(False)),
        ]
        return _union(branches)

    @staticmethod
    def _transaction(df, class_id, id_, objectid, envelope) -> DataFrame:
        day = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
        return _fill(
            df, "feature", id=id_, objectclass_id=F.lit(class_id), objectid=objectid, envelope=envelope,
            creation_date=F.col("o_orderdate"),
            termination_date=F.when(F.col("o_orderstatus") == "F", day(30)),
            valid_from=F.when(F.col("o_orderkey") % 7 != 0, day(1)),
            valid_to=F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), day(60)))

    @staticmethod
    def _other(df, class_id, key, id_, prefix, has_box) -> DataFrame:
        created = F.date_add(F.lit("1994-01-01").cast("date"), (F.col(key) % 365).cast("int")).cast("timestamp")
        return _fill(df, "feature", id=id_, objectclass_id=F.lit(class_id),
                     objectid=F.concat(F.lit(prefix), F.col(key).cast("string")),
                     envelope=F.when(has_box, box(F.col(key))), creation_date=created)

    # -- property

    def property(self) -> DataFrame:
        c, lit = F.col, F.lit
        order, item, detail = order_id("o_orderkey"), item_id(), detail_id()
        customer, supplier, part = customer_id("c_custkey"), supplier_id("s_suppkey"), part_id("p_partkey")
        k, line = c("l_orderkey"), c("l_linenumber")
        first = self.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_suppkey").alias("suppkey"), F.min("l_partkey").alias("partkey"))
        quantities = self.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").distinct()
        flag_no = F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "N", 2).otherwise(3)
        lod = lambda key, level: ((key + level) % 4).cast("string")
        matrix = F.concat(lit("[2,0,0,"), (c("partkey") % 7).cast("string"), lit(",0,2,0,"),
                          (c("partkey") % 5).cast("string"), lit(",0,0,1,0,0,0,0,1]"))
        geometry = lambda df, fid, key, level: _property(
            df, fid, 1, "geometry", "GeometryProperty", val_lod=lod(key, level), val_geometry_id=fid)
        edge = dict(val_relation_type=lit(CONTAINS))
        return _union([
            _property(self.orders, order, 2, "priority", "Code", val_string=c("o_orderpriority")),
            _property(self.orders, order, 3, "price", "Measure", val_double=c("o_totalprice"), val_uom=lit("EUR")),
            _property(self.customer, customer, 2, "segment", "Code", val_string=c("c_mktsegment")),
            _property(self.customer, customer, 3, "balance", "Double", val_double=c("c_acctbal")),
            _property(self.customer, customer, 4, "nation", "Integer", val_int=c("c_nationkey")),
            _property(self.customer, customer, 5, "address", "AddressProperty", ns=1,
                      val_address_id=F.floor(c("c_custkey") / 2)),
            _property(self.supplier, supplier, 3, "balance", "Double", val_double=c("s_acctbal")),
            _property(self.supplier, supplier, 4, "nation", "Integer", val_int=c("s_nationkey")),
            _property(quantities, item, 100 + c("l_quantity").cast("bigint"), "quantity", "Double",
                      val_double=c("l_quantity")),
            _property(self.details, item, 200 + flag_no, "flag", "String", ns=3, val_string=c("l_returnflag")),
            _property(self.part, part, 2, "dims", "Dims"),
            _property(self.part, part, 3, "size", "Integer", parent=2, val_int=c("p_size")),
            _property(self.part, part, 4, "type", "String", parent=2, val_string=c("p_type")),
            _property(self.items, order_id("l_orderkey"), 100 + line, "item", "FeatureProperty",
                      val_feature_id=item, **edge),
            _property(self.details, item, 300 + flag_no, "boundary", "FeatureProperty", ns=1,
                      val_feature_id=detail, **edge),
            _property(self.orders.select("o_orderkey", "o_custkey"), customer_id("o_custkey"), None, "order",
                      "FeatureProperty", id_=order * 1000 + 900, val_feature_id=order,
                      val_relation_type=lit(RELATES)),
            _property(first, item, 5, "supplier", "FeatureProperty", val_feature_id=supplier_id("suppkey"),
                      val_relation_type=lit(RELATES)),
            _property(first, item, 6, "shape", "ImplicitGeometryProperty", val_lod=lod(k + line, 0),
                      val_implicitgeom_id=c("partkey") % 50 + 1, val_array=matrix,
                      val_implicitgeom_refpoint=F.array(k.cast("double"), line.cast("double"), lit(0.0))),
            geometry(self.orders, order, c("o_orderkey"), 0),
            geometry(self.items, item, k, 1),
            geometry(self.details, detail, k, 2),
        ])

    # -- the other tables

    def geometry_data(self) -> DataFrame:
        """Rectangles from the envelopes.

        The always true test on a row number keeps the optimiser from copying the coordinate expressions into every
        predicate and union branch; a stored geometry table has no such expressions.
        """
        boxed = self.feature().where("envelope is not null")
        key = F.shiftright("id", 6)
        point = lambda x, y, z: F.when(
            F.col("envelope.zmin").isNull(), F.array(f"envelope.{x}", f"envelope.{y}")
        ).otherwise(F.array(f"envelope.{x}", f"envelope.{y}", f"envelope.{z}"))
        ring = F.array(point("xmin", "ymin", "zmin"), point("xmax", "ymin", "zmin"), point("xmax", "ymax", "zmin"),
                       point("xmin", "ymax", "zmin"), point("xmin", "ymin", "zmin"))
        node = lambda type_, name, parent, index: F.struct(
            F.lit(type_).alias("type"), F.concat(F.lit("G_"), F.col("id"), F.lit(name)).alias("object_id"),
            F.lit(parent).cast("int").alias("parent"), F.lit(index).cast("int").alias("geometry_index"),
            F.lit(None).cast("boolean").alias("is_reversed"))
        kind = key % 3
        nodes = (
            F.when(kind == 0, F.array(node(5, "", None, 0)))
            .when(kind == 1, F.array(node(8, "", None, None), node(5, "_s0", 0, 0)))
            .otherwise(F.array(node(9, "", None, None), node(6, "_h", 0, None), node(5, "_s0", 1, 0))))
        return _fill(boxed, "geometry_data", id=F.col("id"), feature_id=F.col("id"),
                     geometry_type=F.when(kind == 0, 5).when(kind == 1, 8).otherwise(9),
                     nodes=nodes, primitives=F.when(F.monotonically_increasing_id() >= 0, F.array(F.array(ring))))

    def implicit_geometry(self) -> DataFrame:
        sizes = self.part.select(((F.col("p_partkey") % 50) + 1).alias("tid")).distinct()
        return _fill(sizes, "implicit_geometry", id=F.col("tid"),
                     objectid=F.concat(F.lit("T_"), F.col("tid").cast("string")),
                     reference_to_library=F.when(F.col("tid") % 10 == 0, F.lit("library.glb")),
                     relative_geometry_id=F.when(F.col("tid") % 10 != 0, F.col("tid") * 64))

    def address(self) -> DataFrame:
        key = F.floor(F.col("c_custkey") / 2)
        grouped = self.customer.groupBy(key.alias("aid")).agg(F.min("c_nationkey").alias("nation"))
        return _fill(grouped, "address", id=F.col("aid"), objectid=F.concat(F.lit("A_"), F.col("aid")),
                     street=F.concat(F.lit("Street "), (F.col("aid") % 97).cast("string")),
                     city=F.concat(F.lit("City "), F.col("nation").cast("string")), country=F.lit("N"))

    def appearance(self) -> DataFrame:
        c = F.col
        return _fill(self.customer, "appearance", id=c("c_custkey"), objectid=F.concat(F.lit("AP_"), c("c_custkey")),
                     theme=F.when(c("c_mktsegment") != "HOUSEHOLD", c("c_mktsegment")),
                     feature_id=F.when(c("c_custkey") % 50 != 0, customer_id("c_custkey")))

    def surface_data(self) -> DataFrame:
        c = F.col
        kind = c("c_custkey") % 3
        return _fill(self.customer, "surface_data", id=c("c_custkey"),
                     objectid=F.concat(F.lit("SD_"), c("c_custkey")), objectclass_id=(kind + 41).cast("int"),
                     tex_image_id=F.when(kind > 0, c("c_custkey") % 20), is_front=F.lit(1))

    def tex_image(self) -> DataFrame:
        images = self.customer.select((F.col("c_custkey") % 20).alias("iid")).distinct()
        return _fill(images, "tex_image", id=F.col("iid"), mime_type=F.lit("image/png"),
                     image_uri=F.concat(F.lit("tex_"), F.col("iid").cast("string"), F.lit(".png")))

    def appear_to_surface_data(self) -> DataFrame:
        c = F.col
        return _fill(self.customer, "appear_to_surface_data", id=c("c_custkey"), appearance_id=c("c_custkey"),
                     surface_data_id=c("c_custkey"))

    def surface_data_mapping(self) -> DataFrame:
        """Customer c paints the surface of order c; every fifth mapping names a surface that does not exist."""
        c = F.col
        gid = order_id("c_custkey")
        # a geometry of kind 0 is one polygon that carries the root's own id
        surface = F.concat(
            F.lit("G_"), gid.cast("string"),
            F.when(c("c_custkey") % 5 == 0, "_gone").when(c("c_custkey") % 3 == 0, "").otherwise("_s0"))
        doc = lambda value: F.concat(F.lit('{"'), surface, F.lit('":'), F.lit(value), F.lit("}"))
        two_rings = "[[[0,0],[1,0],[1,1],[0,1],[0,0]],[[0.2,0.2],[0.4,0.2],[0.4,0.4],[0.2,0.2]]]"
        one_ring = "[[[0,0],[1,0],[1,1],[0,1],[0,0]]]"
        kind = c("c_custkey") % 3
        return _fill(
            self.customer, "surface_data_mapping", surface_data_id=c("c_custkey"), geometry_data_id=gid,
            material_mapping=F.when(kind == 0, doc("true")),
            texture_mapping=F.when(kind == 1, F.when(c("c_custkey") % 2 == 0, doc(two_rings)).otherwise(doc(one_ring))),
            georeferenced_texture_mapping=F.when(kind == 2, doc("true")))

    def codelist(self) -> DataFrame:
        region = self._read("region")
        return _fill(region, "codelist", id=F.col("r_regionkey"),
                     codelist_type=F.when(F.col("r_regionkey") % 2 == 0, "class").otherwise("function"),
                     url=F.concat(F.lit("http://example.org/codes/"), F.lower("r_name")))

    def codelist_entry(self) -> DataFrame:
        return _fill(self._read("nation"), "codelist_entry", id=F.col("n_nationkey"),
                     codelist_id=F.col("n_regionkey"), code=F.col("n_nationkey").cast("string"),
                     definition=F.col("n_name"))

    def feature_changelog(self) -> DataFrame:
        c, e = F.col, self._read("events")
        kinds = F.create_map(*[F.lit(v) for pair in (
            ("signup", "insert"), ("view", "update"), ("click", "update"), ("error", "terminate"),
            ("purchase", "delete")) for v in pair])
        k = c("event_id")
        return _fill(
            e, "feature_changelog", id=k, feature_id=customer_id("user_id"), objectclass_id=F.lit(10),
            objectid=F.concat(F.lit("C_"), c("user_id").cast("string")), transaction_type=kinds[c("event_type")],
            transaction_date=c("ts").cast("timestamp"),
            db_user=F.concat(F.lit("u"), (c("user_id") % 5).cast("string")),
            reason_for_update=F.when(c("value") >= 5, F.concat(F.lit("r"), (k % 3).cast("string"))),
            envelope=F.when(k % 11 != 0, box(k, size_x=2003, size_y=1999, block=100_000, flat=F.lit(True))))


def _property(df: DataFrame, fid: Column, code, name: str, datatype: str, ns: int = 2, parent: int | None = None,
              id_: Column | None = None, **values: Column) -> DataFrame:
    if id_ is None:
        id_ = fid * 1000 + code
    if parent is not None:
        values["parent_id"] = fid * 1000 + parent
    return _fill(df, "property", id=id_, feature_id=fid, name=F.lit(name), namespace_id=F.lit(ns),
                 datatype_id=F.lit(DATATYPE_IDS[datatype]), **values)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
