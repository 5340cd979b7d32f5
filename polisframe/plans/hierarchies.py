"""Containment trees, LoD search, assembly and post-processing."""

import datetime as dt

from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions import geometry as geo
from polisframe.operators import hierarchy as h
from polisframe.operators.query import FeatureQuery
from polisframe.plans.registry import query


def _orders(m, *conditions):
    return FeatureQuery(m, ["Order"]).where(*conditions).result()


_TREE = """WITH edges AS (SELECT DISTINCT feature_id AS parent, val_feature_id AS child, namespace_id = 1 AND name = 'boundary'
    AS is_boundary FROM property WHERE val_relation_type = 1),
  roots AS ({roots}),
  tree AS (SELECT id AS root_id, id AS node_id, 0 AS depth FROM roots
    UNION SELECT t.root_id, e.child, t.depth + {cost} FROM tree t JOIN edges e ON e.parent = t.node_id
    {limit})"""
_ORDERS = "SELECT id FROM feature WHERE objectclass_id = 20"


def tree(roots=_ORDERS, cost="1", limit=""):
    return _TREE.format(roots=roots, cost=cost, limit=limit)


def free(depth):
    return tree(cost="CASE WHEN is_boundary THEN 0 ELSE 1 END",
                limit=f"WHERE t.depth + CASE WHEN is_boundary THEN 0 ELSE 1 END <= {depth}")


query("closure", f"{tree()} SELECT root_id, node_id, min(depth) AS depth FROM tree GROUP BY 1, 2", recursive=True)(
    lambda m: h.closure(h.contains_edges(m), _orders(m)))
query("feature_hierarchy", f"""{tree()} SELECT root_id, depth, p.feature_id, p.id, p.name
    FROM tree JOIN property p ON p.feature_id = node_id""", recursive=True)(
    lambda m: h.feature_hierarchy(m, _orders(m)).select("root_id", "depth", "feature_id", "id", "name"))
for _name, _lods, _mode, _depth in (("or_depth0", ("0", "1"), "or", 0), ("or_depth1", ("2",), "or", 1),
                                    ("and_depth1", ("0", "1"), "and", 1), ("and_unlimited", ("1", "2", "3"), "and", None),
                                    ("any", (), "or", 0)):
    def _lod(name=_name, lods=_lods, mode=_mode, depth=_depth):
        listed = f"val_lod IN ({', '.join(repr(x) for x in lods)})" if lods else "val_lod IS NOT NULL"
        having = f"HAVING count(DISTINCT val_lod) = {len(lods)}" if mode == "and" else ""
        t = tree() if depth is None else free(depth)
        query(f"lod_filter_{name}", f"""{t} SELECT root_id AS id FROM tree JOIN property p ON p.feature_id = node_id
            WHERE {listed} GROUP BY 1 {having}""", recursive=True)(
            lambda m: h.lod_filter(m, _orders(m), lods, mode, depth).select("id"))
    _lod()
query("template_usage", f"""{tree("SELECT id FROM feature WHERE objectclass_id = 20 AND termination_date IS NULL")}
    SELECT DISTINCT val_implicitgeom_id AS id, val_lod AS lod FROM tree JOIN property p ON p.feature_id = node_id
    WHERE val_implicitgeom_id IS NOT NULL""", recursive=True)(
    lambda m: h.template_usage(m, FeatureQuery(m, ["Order"]).valid().result()))
query("prune_invalid", """WITH edges AS (SELECT DISTINCT feature_id AS parent, val_feature_id AS child FROM property
      WHERE val_relation_type = 1 AND val_feature_id IN (SELECT id FROM feature WHERE valid_from <= TIMESTAMP '1998-01-01'
        AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01'))),
    tree AS (SELECT id AS root_id, id AS node_id FROM feature WHERE objectclass_id = 20
      UNION SELECT root_id, child FROM tree JOIN edges ON parent = node_id)
    SELECT root_id, node_id FROM tree""", recursive=True)(
    lambda m: h.prune_invalid(m, _orders(m), at=dt.datetime(1998, 1, 1), reference="real_world").select(
        "root_id", "node_id"))

_PRICEY = "SELECT feature_id AS id FROM property WHERE name = 'price' AND val_double > 300000"


def _pricey(m):
    return m.property.where("name = 'price' and val_double > 300000").select(F.col("feature_id").alias("id"))


query("properties_of", f"""SELECT p.id, CASE namespace_id WHEN 1 THEN 'core' WHEN 2 THEN 'own' ELSE 'gen' END AS namespace,
      name, CASE datatype_id WHEN 7 THEN 'Code' WHEN 8 THEN 'Measure' WHEN 9 THEN 'FeatureProperty'
        WHEN 10 THEN 'GeometryProperty' END AS datatype, val_string, val_double
    FROM property p JOIN (SELECT DISTINCT id AS feature_id FROM ({_PRICEY})) USING (feature_id)""")(
    lambda m: h.properties_of(m, _pricey(m)).select("id", "namespace", "name", "datatype", "val_string", "val_double"))
query("features_of", f"SELECT id, objectid, xmin FROM feature WHERE id IN ({_PRICEY})")(
    lambda m: h.features_of(m, _pricey(m)).select("id", "objectid", "envelope.xmin"))
query("geometries_of", f"SELECT id, geometry_type FROM geometry_data WHERE id IN ({_PRICEY})")(
    lambda m: h.geometries_of(m, _pricey(m)).select("id", "geometry_type"))
query("templates_of", """SELECT t.id, t.objectid, reference_to_library, geometry_type
    FROM implicit_geometry t LEFT JOIN geometry_data g ON g.id = t.relative_geometry_id WHERE t.id IN (
      SELECT val_implicitgeom_id FROM property WHERE val_lod = '1')""")(
    lambda m: h.templates_of(m, m.property.where("val_lod = '1' and val_implicitgeom_id is not null").select(
        F.col("val_implicitgeom_id").alias("id"))).select("id", "objectid", "reference_to_library", "geometry_type"))
query("appearances_of", """SELECT a.id, a.objectid, theme, s.id AS surface_data_id, image_uri, geometry_data_id
    FROM appearance a JOIN appear_to_surface_data l ON l.appearance_id = a.id JOIN surface_data s ON s.id = l.surface_data_id
    LEFT JOIN tex_image t ON t.id = s.tex_image_id LEFT JOIN surface_data_mapping x ON x.surface_data_id = s.id
    WHERE a.feature_id IS NOT NULL AND (theme IN ('MACHINERY', 'FURNITURE') OR theme IS NULL)""")(
    lambda m: h.appearances_of(m, m.feature.select("id"), ["MACHINERY", "FURNITURE", None]).select(
        "id", "objectid", "theme", "surface_data_id", "image_uri", "geometry_data_id"))
query("addresses_of", """SELECT DISTINCT p.feature_id, a.id, street, city FROM property p JOIN address a ON a.id = p.val_address_id
    WHERE p.feature_id IN (SELECT id FROM feature WHERE objectclass_id = 10 AND xmin IS NOT NULL)""")(
    lambda m: h.addresses_of(m, m.feature.where("objectclass_id = 10 and envelope is not null")).select(
        "feature_id", "id", "street", "city"))

query("assemble", f"""{tree(_PRICEY)} SELECT root_id, depth, node_id AS feature_id, objectclass_id, f.objectid, p.id,
      p.parent_id, p.name, p.val_feature_id, false AS is_reference
    FROM tree JOIN feature f ON f.id = node_id LEFT JOIN property p ON p.feature_id = node_id""", recursive=True)(
    lambda m: h.assemble(m, _pricey(m)).select("root_id", "depth", "feature_id", "objectclass_id", "objectid", "id",
                                               "parent_id", "name", "val_feature_id", "is_reference"))
# contains edges by name, as the trees of the model have three levels; suppliers that items share are a second occurrence
_JSON = """WITH value AS MATERIALIZED (SELECT p.*, coalesce(val_string, CAST(val_int AS VARCHAR), CAST(CAST(round(val_double * 100) AS BIGINT) AS VARCHAR)) AS v,
      t.objectid AS target FROM property p LEFT JOIN feature t ON t.id = p.val_feature_id
      WHERE p.feature_id // 64 IN (SELECT id // 64 FROM ({roots})) AND p.feature_id % 64 < 60),
  d AS (SELECT p.feature_id, string_agg('{{"children":[],"feature":null,"id":' || p.id || ',"lod":' || coalesce('"' || val_lod || '"', 'null') || ',"name":"' || name
      || '","reference":null,"value":' || coalesce('"' || v || '"', 'null') || '}}', ',' ORDER BY name, p.id) AS ps
    FROM value p WHERE p.feature_id % 64 >= 16 GROUP BY 1),
  dj AS (SELECT f.id, '{{"class":"ItemDetail","id":' || f.id || ',"objectid":"' || f.objectid || '","properties":[' || coalesce(ps, '') || ']}}' AS j
    FROM feature f LEFT JOIN d ON d.feature_id = f.id WHERE f.objectclass_id = 22),
  i AS (SELECT p.feature_id, string_agg('{{"children":[],"feature":' || coalesce(j, 'null') || ',"id":' || p.id || ',"lod":' || coalesce('"' || val_lod || '"', 'null')
      || ',"name":"' || name || '","reference":' || coalesce('"' || CASE WHEN j IS NULL THEN target END || '"', 'null') || ',"value":' || coalesce('"' || v || '"', 'null') || '}}', ','
      ORDER BY name, p.id) AS ps FROM value p LEFT JOIN dj ON dj.id = p.val_feature_id AND name = 'boundary' WHERE p.feature_id % 64 BETWEEN 1 AND 15 GROUP BY 1),
  ij AS (SELECT f.id, '{{"class":"OrderItem","id":' || f.id || ',"objectid":"' || f.objectid || '","properties":[' || coalesce(ps, '') || ']}}' AS j
    FROM feature f LEFT JOIN i ON i.feature_id = f.id WHERE f.objectclass_id = 21),
  o AS (SELECT p.feature_id, string_agg('{{"children":[],"feature":' || coalesce(j, 'null') || ',"id":' || p.id || ',"lod":' || coalesce('"' || val_lod || '"', 'null')
      || ',"name":"' || name || '","reference":null,"value":' || coalesce('"' || v || '"', 'null') || '}}', ',' ORDER BY name, p.id) AS ps
    FROM value p LEFT JOIN ij ON ij.id = p.val_feature_id WHERE p.feature_id % 64 = 0 GROUP BY 1)
  SELECT r.id AS root_id, '{{"class":"Order","id":' || r.id || ',"objectid":"' || f.objectid || '","properties":[' || coalesce(ps, '') || ']}}' AS tree
  FROM ({roots}) r JOIN feature f ON f.id = r.id LEFT JOIN o ON o.feature_id = r.id"""


def _text_value():
    cents = F.round(F.col("val_double") * 100).cast("bigint").cast("string")
    return F.coalesce("val_string", F.col("val_int").cast("string"), cents).cast("variant")


query("nested_trees", _JSON.format(roots=_PRICEY))(
    lambda m: h.nested(m, _pricey(m), _text_value()).select("root_id", F.to_json("tree").alias("tree")))
query("sort_properties", """SELECT p.feature_id AS root_id, p.id, name, row_number() OVER (PARTITION BY p.feature_id ORDER BY name, p.id) AS pos
    FROM property p""")(
    lambda m: h.sorted_properties(m.property).select(F.col("feature_id").alias("root_id"), "id", "name", "pos"))


def _shared_suppliers(m):
    """The model in which items contain their suppliers, so that some suppliers occur twice in an order."""
    return m.replace(property=m.property.withColumn("val_relation_type", F.when(F.col("name") == "supplier", 1).otherwise(F.col("val_relation_type"))))


_SHARED = f"""WITH r AS ({_PRICEY}), s AS (SELECT r.id AS root_id, i.feature_id AS item, i.id AS property_id, i.val_feature_id AS supplier
    FROM r JOIN property c ON c.feature_id = r.id AND c.name = 'item' JOIN property i ON i.feature_id = c.val_feature_id AND i.name = 'supplier'),
  first AS (SELECT root_id, supplier, min(property_id) AS property_id FROM s GROUP BY 1, 2)"""
query("nested_second_occurrences", _SHARED + """ SELECT root_id, s.property_id, CASE WHEN first.property_id IS NULL THEN 'S_' || (supplier // 64) END AS reference,
    CASE WHEN first.property_id IS NOT NULL THEN 'S_' || (supplier // 64) END AS feature FROM s LEFT JOIN first USING (root_id, supplier, property_id)""")(
    lambda m: _suppliers(_shared_suppliers(m)))


def _suppliers(m):
    get = lambda path, kind: F.expr(f"variant_get({path}, '{kind}')")
    inner = "array<variant>"
    items = h.nested(m, _pricey(m)).select("root_id", F.explode(get("tree, '$.properties'", inner)).alias("p")).select(
        "root_id", F.explode(get("p, '$.feature.properties'", inner)).alias("i"))
    return items.where(get("i, '$.name'", "string") == "supplier").select(
        "root_id", get("i, '$.id'", "bigint").alias("property_id"), get("i, '$.reference'", "string").alias("reference"), get("i, '$.feature.objectid'", "string").alias("feature"))


query("assemble_second_occurrences", _SHARED + """, found AS (SELECT DISTINCT root_id, supplier FROM s)
    SELECT count(*) AS suppliers, (SELECT count(*) FROM s) AS occurrences FROM found""")(
    lambda m: _occurrences(_shared_suppliers(m)))


def _occurrences(m):
    rows = h.assemble(m, _pricey(m))
    found = rows.where("objectclass_id = 11 and not is_reference").select("root_id", "feature_id").distinct().select(F.lit(1).alias("a"), F.lit(0).alias("b"))
    held = rows.where("name = 'supplier'").select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return found.unionByName(held).agg(F.sum("a").alias("suppliers"), F.sum("b").alias("occurrences"))


query("nested_attributes", """SELECT p.feature_id, p.name AS outer_name, c.name AS inner_name, c.val_int, c.val_string
    FROM property c JOIN property p ON p.id = c.parent_id AND p.feature_id = c.feature_id WHERE c.parent_id IS NOT NULL""")(
    lambda m: m.property.where("parent_id is not null").select("parent_id", F.col("name").alias("inner_name"),
                                                               "val_int", "val_string")
    .join(m.property.select(F.col("id").alias("parent_id"), "feature_id", F.col("name").alias("outer_name")),
          "parent_id").drop("parent_id"))
_ROWS = f"{tree()}, rows AS (SELECT root_id, p.* FROM tree JOIN property p ON p.feature_id = node_id)"
for _mode in ("keep", "remove", "minimum", "maximum"):
    def _keep(mode=_mode):
        target = {"minimum": "min", "maximum": "max"}.get(mode)
        if target:
            sql = f"""{_ROWS}, target AS (SELECT root_id, {target}(val_lod) AS lod FROM rows WHERE val_lod IN ('1', '2')
                GROUP BY 1) SELECT rows.root_id, id FROM rows LEFT JOIN target USING (root_id)
                WHERE val_lod IS NULL OR val_lod = lod"""
        else:
            sql = f"""{_ROWS} SELECT root_id, id FROM rows WHERE val_lod IS NULL OR val_lod
                {'' if mode == 'keep' else 'NOT'} IN ('1', '2')"""
        query(f"keep_lods_{mode}", sql, recursive=True)(
            lambda m: h.keep_lods(h.feature_hierarchy(m, _orders(m)), ["1", "2"], mode).select("root_id", "id"))
    _keep()
_OWN = """boxes AS (
    SELECT p.feature_id, g.xmin, g.ymin, g.zmin, g.xmax, g.ymax, g.zmin AS zmax
    FROM property p JOIN geometry_data g ON g.id = p.val_geometry_id
    UNION ALL SELECT p.feature_id,
      2 * coalesce(g.xmin, 0) + mx + ref_x, 2 * coalesce(g.ymin, 0) + my + ref_y, coalesce(g.zmin, CASE WHEN g.xmin IS NULL
        THEN 0 END), 2 * coalesce(g.xmax, 0) + mx + ref_x, 2 * coalesce(g.ymax, 0) + my + ref_y,
      coalesce(g.zmin, CASE WHEN g.xmin IS NULL THEN 0 END)
    FROM (SELECT *, CAST(split_part(val_array, ',', 4) AS DOUBLE) AS mx, CAST(split_part(val_array, ',', 8) AS DOUBLE) AS my
      FROM property WHERE val_implicitgeom_id IS NOT NULL) p
    JOIN implicit_geometry t ON t.id = p.val_implicitgeom_id
    LEFT JOIN geometry_data g ON g.id = t.relative_geometry_id)"""
_BOX = ("min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax, max(ymax) AS ymax, "
        "max(zmax) AS zmax")
query("template_envelope", f"""WITH {_OWN} SELECT feature_id, {_BOX} FROM boxes GROUP BY 1""")(
    lambda m: h.own_envelopes(m).select("feature_id", *env.fields("envelope")))
query("update_envelopes", f"""{tree()}, {_OWN}, new AS (
      SELECT root_id AS id, {_BOX} FROM tree JOIN boxes ON feature_id = node_id GROUP BY 1)
    SELECT f.id, coalesce(n.xmin, f.xmin) AS xmin, coalesce(n.ymin, f.ymin) AS ymin, coalesce(n.xmax, f.xmax) AS xmax,
      coalesce(n.ymax, f.ymax) AS ymax FROM feature f LEFT JOIN new n ON n.id = f.id WHERE objectclass_id = 20""",
      recursive=True)(
    lambda m: h.update_envelopes(m, m.feature.where("objectclass_id = 20")).select(
        "id", "envelope.xmin", "envelope.ymin", "envelope.xmax", "envelope.ymax"))
query("update_envelopes_all", f"""{tree("SELECT id FROM feature")}, {_OWN}, new AS (
      SELECT root_id AS id, {_BOX} FROM tree JOIN boxes ON feature_id = node_id GROUP BY 1)
    SELECT f.id, coalesce(n.xmin, f.xmin) AS xmin, coalesce(n.ymin, f.ymin) AS ymin, coalesce(n.xmax, f.xmax) AS xmax,
      coalesce(n.ymax, f.ymax) AS ymax FROM feature f LEFT JOIN new n ON n.id = f.id""", recursive=True)(
    lambda m: h.update_envelopes(m).select("id", "envelope.xmin", "envelope.ymin", "envelope.xmax", "envelope.ymax"))
_M = (0.5, -2.0, 0.0, 10.0, 2.0, 0.5, 0.0, -5.0, 0.0, 0.0, 1.0, 3.0)
query("affine_transform", """SELECT id, 0.5 * xmin - 2 * ymax + 10 AS xmin, 2 * xmin + 0.5 * ymin - 5 AS ymin,
      zmin + 3 AS zmin, 0.5 * xmax - 2 * ymin + 10 AS xmax, 2 * xmax + 0.5 * ymax - 5 AS ymax, zmax + 3 AS zmax
    FROM feature WHERE xmin IS NOT NULL""".replace("0.5 *", "0.5::DOUBLE *"))(
    lambda m: geo.affine_transform(m.feature.where("envelope is not null"), _M).select("id", *env.fields("envelope")))
query("affine_transform_geometry", """SELECT id, 0.5::DOUBLE * xmin - 2 * ymin + 10 AS x0, 2 * xmin + 0.5::DOUBLE * ymin - 5 AS y0,
      zmin + 3 AS z0 FROM geometry_data""")(
    lambda m: geo.affine_transform(m.geometry_data, _M).select(
        "id", *[F.get(F.col("primitives")[0][0][0], i).alias(n) for i, n in enumerate(("x0", "y0", "z0"))]))
query("affine_swap_xy", "SELECT id, ymin AS xmin, xmin AS ymin, ymax AS xmax, xmax AS ymax FROM feature WHERE xmin IS NOT NULL")(
    lambda m: geo.affine_transform(m.feature.where("envelope is not null"), "swap-xy").select(
        "id", "envelope.xmin", "envelope.ymin", "envelope.xmax", "envelope.ymax"))
query("flatten_geometry", """SELECT id, pos, CASE WHEN kind = 0 OR pos = kind THEN 5 WHEN kind = 1 THEN 8 WHEN pos = 0 THEN 9
        ELSE 6 END AS type, CASE WHEN pos = 0 THEN NULL ELSE pos - 1 END AS parent, pos = kind AS is_leaf
    FROM (SELECT id, (id // 64) % 3 AS kind, unnest(range(0, (id // 64) % 3 + 1)) AS pos FROM geometry_data)""")(
    lambda m: geo.flatten_geometry(m.geometry_data).select(
        "id", "pos", "type", "parent", F.col("rings").isNotNull().alias("is_leaf")))
query("rebuild_geometry", """SELECT id, geometry_type, (id // 64) % 3 + 1 AS nodes, 1 AS primitives, xmax AS x2 FROM geometry_data""")(
    lambda m: geo.rebuild_geometry(geo.flatten_geometry(m.geometry_data)).select(
        "id", "geometry_type", F.size("nodes").alias("nodes"), F.size("primitives").alias("primitives"),
        F.col("primitives")[0][0][2][0].alias("x2")))

_MAPPED = """SELECT surface_data_id, geometry_data_id, surface_object_id AS object_id,
      CASE WHEN material THEN 'material' WHEN texture THEN 'texture' ELSE 'georeferenced' END AS kind
    FROM surface_data_mapping s JOIN feature f ON f.id = geometry_data_id
    WHERE surface_object_id NOT LIKE '%_gone' AND (NOT texture OR texture_rings = 1)"""
query("map_surface_data", _MAPPED)(lambda m: h.map_surface_data(m).drop("value"))
query("drop_empty_appearances", f"""WITH mapped AS ({_MAPPED})
    SELECT a.id, theme FROM appearance a JOIN appear_to_surface_data l ON l.appearance_id = a.id
    WHERE l.surface_data_id IN (SELECT surface_data_id FROM mapped)""")(
    lambda m: h.drop_empty_surface_data(h.map_surface_data(m), m)[1].select("id", "theme"))
query("drop_empty", f"""{_ROWS}, kept AS (SELECT * FROM rows WHERE val_lod IS NULL OR val_lod = '2'),
    shaped AS (SELECT DISTINCT root_id, feature_id AS node_id FROM kept WHERE val_geometry_id IS NOT NULL
      OR val_implicitgeom_id IS NOT NULL
      UNION SELECT k.root_id, k.feature_id FROM shaped s JOIN kept k ON k.root_id = s.root_id
        AND k.val_feature_id = s.node_id AND k.val_relation_type = 1),
    keep AS (SELECT root_id, node_id FROM shaped UNION SELECT root_id, root_id FROM kept),
    filled AS (SELECT k.* FROM kept k JOIN keep o ON o.root_id = k.root_id AND o.node_id = k.feature_id
      WHERE k.val_relation_type IS DISTINCT FROM 1
        OR EXISTS (SELECT 1 FROM keep t WHERE t.root_id = k.root_id AND t.node_id = k.val_feature_id)),
    shapes AS (SELECT root_id, val_geometry_id AS geometry_id FROM filled WHERE val_geometry_id IS NOT NULL
      UNION SELECT root_id, relative_geometry_id FROM filled JOIN implicit_geometry t ON t.id = val_implicitgeom_id),
    mapped AS ({_MAPPED}),
    painted AS (SELECT DISTINCT root_id, surface_data_id FROM shapes JOIN mapped ON geometry_data_id = geometry_id)
    SELECT root_id, id, 'property' AS table_name FROM filled
    UNION ALL SELECT root_id, s.id, 'surface_data' FROM painted p JOIN surface_data s ON s.id = p.surface_data_id
    UNION ALL SELECT DISTINCT root_id, a.id, 'appearance' FROM painted p JOIN appear_to_surface_data l ON l.surface_data_id = p.surface_data_id
      JOIN appearance a ON a.id = l.appearance_id""", recursive=True)(
    lambda m: _cleaned(m))


def _cleaned(m):
    """What is left of the orders' trees: property rows, and the surface data and appearances that still paint them."""
    rows = h.drop_empty(m, h.keep_lods(h.feature_hierarchy(m, _orders(m)), ["2"]))
    data, appearances = h.drop_empty_surface_data(h.map_surface_data(m, rows), m)
    left = [df.select("root_id", "id", F.lit(name).alias("table_name")) for name, df in (("property", rows), ("surface_data", data), ("appearance", appearances))]
    return left[0].unionByName(left[1]).unionByName(left[2])


query("hierarchy_type_summary", f"""{tree()} SELECT 'own:' || classname AS type_name, count(*) AS n
    FROM (SELECT DISTINCT root_id, node_id FROM tree) t JOIN feature f ON f.id = t.node_id
    JOIN objectclass c ON c.id = f.objectclass_id GROUP BY 1""", recursive=True)(
    lambda m: _summary(m))


def _summary(m):
    from polisframe.operators.statistics import type_summary
    nodes = h.closure(h.contains_edges(m), _orders(m)).select(F.col("node_id").alias("id"))
    return type_summary(m, nodes.join(m.feature.select("id", "objectclass_id"), "id"))
