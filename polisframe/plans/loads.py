"""Loading: filters, keys, duplicates, references, metadata, merging, and load-time rewrites."""

import datetime as dt

from pyspark.sql import functions as F

from polisframe.operators import loading as ld
from polisframe.operators import preprocess as pp
from polisframe.operators.hierarchy import closure, contains_edges
from polisframe.plans.hierarchies import tree
from polisframe.plans.registry import query

def now():
    return F.lit(dt.datetime(2024, 6, 1))


def incoming(m):
    """A second delivery: the orders of even key again, and new ones beyond the stored keys."""
    orders = m.feature.where("objectclass_id = 20")
    again = orders.where(F.shiftright("id", 6) % 2 == 0)
    top = orders.agg(F.max("id")).first()[0]
    new = orders.where(F.shiftright("id", 6) % 3 == 0).withColumn("objectid", F.concat(F.lit("N"), "objectid"))
    return again.unionByName(new).withColumn(
        "id", F.col("id") + (top // 64 + 1) * 64 + F.when(F.col("objectid").startswith("N"), 1).otherwise(0))


_IN = """incoming AS (SELECT objectid, termination_date FROM feature WHERE objectclass_id = 20 AND (id // 64) % 2 = 0
    UNION ALL SELECT 'N' || objectid, termination_date FROM feature WHERE objectclass_id = 20 AND (id // 64) % 3 = 0)"""

query("filter_by_type", "SELECT id FROM feature WHERE objectclass_id IN (20, 30)")(
    lambda m: ld.filter_by_type(m.feature, m, ["order", "own:Part"]).select("id"))
query("filter_by_ids", "SELECT id FROM feature WHERE objectid IN (SELECT 'O_' || l_orderkey FROM lineitem WHERE l_quantity = 50)")(
    lambda m: ld.filter_by_ids(m.feature, m.property.where("name = 'quantity' and val_double = 50").select(
        F.concat(F.lit("O_"), F.shiftright("feature_id", 6)).alias("objectid"))).select("id"))
for _mode, _where in (("intersects", "xmin <= 400 AND xmax >= 100 AND ymin <= 400 AND ymax >= 100"),
                      ("contains", "xmin >= 100 AND xmax <= 400 AND ymin >= 100 AND ymax <= 400"),
                      ("on_tile", "(xmin + xmax) / 2 > 100 AND (xmin + xmax) / 2 <= 400 AND (ymin + ymax) / 2 > 100 "
                                  "AND (ymin + ymax) / 2 <= 400")):
    def _bbox(mode=_mode, where=_where):
        query(f"filter_by_bbox_{mode}", f"SELECT id FROM feature WHERE {where}")(
            lambda m: ld.filter_by_bbox(m.feature, (100, 100, 400, 400), mode).select("id"))
    _bbox()
query("load_limit", "SELECT id FROM feature WHERE objectclass_id IN (20, 21) ORDER BY objectclass_id, id LIMIT 900 OFFSET 300")(
    lambda m: ld.load_limit(m.feature.where("objectclass_id in (20, 21)"), 900, 300, ("objectclass_id", "id")).select("id"))
query("load_limit_deep", "SELECT id FROM feature WHERE objectclass_id IN (20, 21) ORDER BY objectclass_id, id LIMIT 20000 OFFSET 12000")(
    lambda m: ld.load_limit(m.feature.where("objectclass_id in (20, 21)"), 20000, 12000, ("objectclass_id", "id")).select("id"))
query("assign_ids", "SELECT id AS old_id, 999 + row_number() OVER (ORDER BY id) AS new_id FROM feature")(
    lambda m: ld.assign_ids(m.feature.select(F.col("id").alias("old_id")), 1000, [F.col("old_id")], "new_id"))
query("assign_ids_any_order", "SELECT count(*) AS n, count(*) AS keys, 7 AS low, count(*) + 6 AS high FROM property")(
    lambda m: ld.assign_ids(m.property.select("name"), 7, name="key").agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("key").alias("low"), F.max("key").alias("high")))
query("dedupe_objects", """SELECT id, row_number() OVER (PARTITION BY val_string ORDER BY id) > 1 AS is_reference
    FROM property WHERE name IN ('flag', 'priority')""")(
    lambda m: ld.dedupe_objects(m.property.where("name in ('flag', 'priority')").select(
        "id", F.lit("address").alias("kind"), F.col("val_string").alias("objectid"), F.col("id").alias("seq")))
    .select("id", "is_reference"))


def _refs(m):
    """References by object id: each item to its supplier and part names, some of which do not exist."""
    suppliers = m.property.where("name = 'supplier'").select(
        F.lit("feature").alias("kind"), F.concat(F.lit("S_"), F.shiftright("val_feature_id", 6) * 2).alias("objectid"),
        F.col("id").alias("ref"))
    images = m.surface_data.where("tex_image_id is not null").select(
        F.lit("tex_image").alias("kind"), F.concat(F.lit("tex_"), F.col("tex_image_id") * 2, F.lit(".png")).alias("objectid"),
        F.col("id").alias("ref"))
    targets = m.feature.where("objectclass_id = 11").select(F.lit("feature").alias("kind"), "objectid", "id")
    more = targets.where("id % 128 = 61").withColumn("id", F.col("id") + 1)  # a second target of the same object id
    files = m.tex_image.select(F.lit("tex_image").alias("kind"), F.col("image_uri").alias("objectid"), "id")
    return suppliers.unionByName(images), targets.unionByName(more).unionByName(files)


_REFS = """refs AS (SELECT 'feature' AS kind, 'S_' || ((val_feature_id // 64) * 2) AS objectid, id AS ref FROM property
      WHERE name = 'supplier'
    UNION ALL SELECT 'tex_image', 'tex_' || (tex_image_id * 2) || '.png', id FROM surface_data WHERE tex_image_id IS NOT NULL),
  targets AS (SELECT 'feature' AS kind, 'S_' || s_suppkey AS objectid,
      s_suppkey * 64 + 61 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS id FROM supplier
    UNION ALL SELECT 'tex_image', image_uri, id FROM tex_image)"""
query("resolve_references", f"""WITH {_REFS} SELECT ref, r.kind, t.id AS target_id FROM refs r
    LEFT JOIN targets t ON t.kind = r.kind AND t.objectid = r.objectid""")(
    lambda m: ld.resolve_references(*_refs(m)).select("ref", "kind", "target_id"))
query("unresolved_references", f"""WITH {_REFS} SELECT DISTINCT kind, objectid FROM refs r WHERE kind <> 'tex_image'
    AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.kind = r.kind AND t.objectid = r.objectid)""")(
    lambda m: ld.unresolved_references(*_refs(m)))
query("find_duplicates", f"""WITH {_IN} SELECT DISTINCT f.objectid, f.id FROM feature f JOIN incoming i
    ON i.objectid = f.objectid WHERE f.termination_date IS NULL""")(lambda m: ld.find_duplicates(incoming(m), m))

_DUP = "(objectclass_id = 20 AND (id // 64) % 2 = 0 AND termination_date IS NULL)"
_COUNT = "SELECT objectclass_id, count(*) AS n, count(*) FILTER (WHERE termination_date IS NULL) AS active FROM ({}) GROUP BY 1"
_NEW = ("SELECT objectclass_id, termination_date FROM feature WHERE objectclass_id = 20 AND (id // 64) % 2 = 0 {} "
        "UNION ALL SELECT objectclass_id, termination_date FROM feature WHERE objectclass_id = 20 AND (id // 64) % 3 = 0")
_TREE_DUP = f"{tree(f'SELECT id FROM feature WHERE {_DUP}')}, gone AS (SELECT DISTINCT node_id AS id FROM tree)"


def _merged(m, mode):
    from polisframe.model import CityModel
    merged, _ = ld.merge_load(m, CityModel(m.spark, {"feature": incoming(m)}, m.types), mode, now())
    return merged.feature.groupBy("objectclass_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("termination_date").isNull(), 1).otherwise(0)).alias("active"))


query("merge_import_all", _COUNT.format(f"SELECT objectclass_id, termination_date FROM feature UNION ALL {_NEW.format('')}"))(
    lambda m: _merged(m, "import_all"))
query("merge_skip", _COUNT.format("SELECT objectclass_id, termination_date FROM feature UNION ALL "
                                  + _NEW.format("AND termination_date IS NOT NULL")))(lambda m: _merged(m, "skip"))
query("merge_delete", f"{_TREE_DUP} " + _COUNT.format(
    f"SELECT objectclass_id, termination_date FROM feature WHERE id NOT IN (SELECT id FROM gone) UNION ALL {_NEW.format('')}"),
    recursive=True)(lambda m: _merged(m, "delete"))
query("merge_terminate", f"{_TREE_DUP} " + _COUNT.format(
    f"""SELECT objectclass_id, CASE WHEN id IN (SELECT id FROM gone) THEN TIMESTAMP '2024-06-01' ELSE termination_date END
      AS termination_date FROM feature UNION ALL {_NEW.format('')}"""), recursive=True)(lambda m: _merged(m, "terminate"))


def _preview(m):
    from polisframe.model import CityModel
    return ld.merge_load(m, CityModel(m.spark, {"feature": incoming(m)}, m.types), "skip", now(), preview=True)[1]


query("merge_preview", f"""WITH {_IN} SELECT (SELECT count(*) FROM feature WHERE {_DUP}) AS duplicates,
    (SELECT count(*) FROM incoming) - (SELECT count(*) FROM feature WHERE {_DUP}) AS added""")(_preview)
query("apply_metadata", """SELECT id, strftime(coalesce(valid_from, TIMESTAMP '2024-06-01'), '%Y-%m-%d') AS created,
    'loader' AS updating_person, '2024-06-01' AS modified FROM feature WHERE objectclass_id = 20""")(
    lambda m: ld.apply_metadata(m.feature.where("objectclass_id = 20").withColumn("creation_date", F.col("valid_from")),
                                now(), person="loader").select(
        "id", F.date_format("creation_date", "yyyy-MM-dd").alias("created"), "updating_person",
        F.date_format("last_modification_date", "yyyy-MM-dd").alias("modified")))
query("apply_metadata_fixed", "SELECT id, '2020-02-02' AS created FROM feature WHERE objectclass_id = 10")(
    lambda m: ld.apply_metadata(m.feature.where("objectclass_id = 10"), now(), "fixed", F.lit(dt.datetime(2020, 2, 2)))
    .select("id", F.date_format("creation_date", "yyyy-MM-dd").alias("created")))
query("lineage_from_file", """SELECT objectid, 'loaded from ' || objectid || '.city.json as ' || objectid || '.city' AS lineage
    FROM feature WHERE objectclass_id = 10""")(
    lambda m: m.feature.where("objectclass_id = 10").select("objectid", ld.lineage_from_file(
        "loaded from @file_name@ as @FILE_BASE_NAME@",
        F.concat(F.lit("file:///data/in/"), "objectid", F.lit(".city.json"))).alias("lineage")))
query("load_hook", "SELECT id, lower(objectid) AS objectid FROM feature WHERE objectclass_id = 20 AND termination_date IS NULL")(
    lambda m: ld.load_hook(m.feature.where("objectclass_id = 20"), lambda df: df.withColumn(
        "objectid", F.when(F.col("termination_date").isNull(), F.lower("objectid")))).select("id", "objectid"))


# -- shredding

def objects(m):
    """Orders, with their items as sub-objects, in the form a file reader delivers."""
    price = m.property.where("name = 'price'").select(F.col("feature_id").alias("id"), F.col("val_double").alias("price"))
    attributes = F.parse_json(F.to_json(F.struct(
        F.col("price"), (F.shiftright("id", 6) % 2 == 0).alias("even"), F.shiftright("id", 6).alias("key"),
        F.struct(F.col("objectid").alias("label"), F.struct((F.col("id") % 10).alias("digit")).alias("inner")).alias("detail"),
        F.array(F.lit(1), F.lit(2)).alias("list"))))
    shape = F.array(F.struct(F.lit("1").alias("lod"), "geometry_type", "nodes", "primitives"))
    g = m.geometry_data.select("id", "geometry_type", "nodes", "primitives")
    none = F.array().cast("array<struct<lod:string,geometry_type:int,nodes:array<struct<type:int,object_id:string,"
                          "parent:int,geometry_index:int,is_reversed:boolean>>,primitives:array<array<array<array<double>>>>>>")
    orders = m.feature.where("objectclass_id = 20").join(price, "id").join(g, "id").select(
        "id", "objectid", F.lit(None).cast("string").alias("parent_objectid"), "objectclass_id", "envelope",
        attributes.alias("attributes"), shape.alias("geometries"))
    items = m.feature.where("objectclass_id = 21").select(
        "id", "objectid", F.concat(F.lit("O_"), F.shiftright("id", 6)).alias("parent_objectid"), "objectclass_id",
        "envelope", F.lit(None).cast("variant").alias("attributes"), none.alias("geometries"))
    both = orders.unionByName(items)
    return both.unionByName(both.where("id % 640 = 0")).withColumn("seq", F.col("id")).withColumn("file", F.lit("f"))


def _shredded(m):
    out = ld.shred(objects(m).dropDuplicates(["id"]), m)
    p = out.property.groupBy("name").agg(
        F.count("*").alias("n"), F.count("parent_id").alias("nested"), F.sum("val_int").alias("ints"),
        F.round(F.sum("val_double"), 2).alias("doubles"), F.count("val_string").alias("strings"),
        F.count("val_array").alias("arrays"), F.count("val_geometry_id").alias("shapes"))
    return p


query("shred", """WITH o AS (SELECT id, id // 64 AS k FROM feature WHERE objectclass_id = 20), c AS (SELECT count(*) AS n FROM o)
    SELECT 'price' AS name, n, 0 AS nested, NULL::BIGINT AS ints, (SELECT round(sum(val_double), 2) FROM property
      WHERE name = 'price') AS doubles, 0 AS strings, 0 AS arrays, 0 AS shapes FROM c
    UNION ALL SELECT 'even', n, 0, (SELECT count(*) FROM o WHERE k % 2 = 0), NULL, 0, 0, 0 FROM c
    UNION ALL SELECT 'key', n, 0, (SELECT sum(k) FROM o), NULL, 0, 0, 0 FROM c
    UNION ALL SELECT 'detail', n, 0, NULL, NULL, 0, 0, 0 FROM c
    UNION ALL SELECT 'label', n, n, NULL, NULL, n, 0, 0 FROM c
    UNION ALL SELECT 'inner', n, n, NULL, NULL, 0, 0, 0 FROM c
    UNION ALL SELECT 'digit', n, n, (SELECT sum(id % 10) FROM o), NULL, 0, 0, 0 FROM c
    UNION ALL SELECT 'list', n, 0, NULL, NULL, 0, n, 0 FROM c
    UNION ALL SELECT 'lod1Geometry', n, 0, NULL, NULL, 0, 0, n FROM c
    UNION ALL SELECT 'child', (SELECT count(*) FROM feature WHERE objectclass_id = 21), 0, NULL, NULL, 0, 0, 0 FROM c""")(
    _shredded)


# -- rewrites

_TOP = """WITH painted AS (SELECT a.id AS appearance_id, s.geometry_data_id AS gid FROM appearance a
      JOIN appear_to_surface_data l ON l.appearance_id = a.id JOIN surface_data_mapping s ON s.surface_data_id = l.surface_data_id
      WHERE a.feature_id IS NULL),
    owner AS (SELECT p.*, f.id AS owner_id FROM painted p JOIN geometry_data g ON g.id = p.gid JOIN feature f ON f.id = g.feature_id)"""
for _mode in ("toplevel", "child"):
    def _global(mode=_mode):
        query(f"attach_global_appearances_{mode}", f"""{_TOP}
            SELECT feature_id, theme FROM appearance WHERE feature_id IS NOT NULL
            UNION ALL SELECT owner_id, theme FROM (SELECT DISTINCT appearance_id, owner_id FROM owner) o
            JOIN appearance a ON a.id = o.appearance_id
            UNION ALL SELECT NULL, theme FROM appearance WHERE feature_id IS NULL
              AND id NOT IN (SELECT appearance_id FROM owner)""")(
            lambda m: pp.attach_global_appearances(m, mode).appearance.select("feature_id", "theme"))
    _global()


def borrowed(m):
    """Customers that use the geometry of each of their orders as a footprint."""
    rows = m.property.where("name = 'order'").withColumns({
        "id": F.col("id") + 1, "name": F.lit("footprint"), "val_geometry_id": F.col("val_feature_id"),
        "val_lod": F.lit("0"), "val_feature_id": F.lit(None).cast("bigint"),
        "val_relation_type": F.lit(None).cast("int")})
    return m.replace(property=m.property.unionByName(rows.select(*m.property.columns)))


query("resolve_geometry_references", """SELECT feature_id, count(*) AS n, sum(own) AS own FROM (
      SELECT feature_id, 1 AS own FROM property WHERE val_geometry_id IS NOT NULL
      UNION ALL SELECT feature_id, 1 FROM property WHERE name = 'order') GROUP BY 1""")(
    lambda m: _borrowed_owners(pp.resolve_geometry_references(borrowed(m))))


def _borrowed_owners(m):
    g = m.geometry_data.select(F.col("id").alias("val_geometry_id"), F.col("feature_id").alias("owner"))
    return m.property.where("val_geometry_id is not null").join(g, "val_geometry_id").groupBy("feature_id").agg(
        F.count("*").alias("n"), F.sum((F.col("owner") == F.col("feature_id")).cast("bigint")).alias("own"))


query("shared_geometry_relations", """SELECT feature_id, val_feature_id FROM property WHERE name = 'order'
    UNION ALL SELECT val_feature_id, feature_id FROM property WHERE name = 'order'""")(
    lambda m: pp.resolve_geometry_references(borrowed(m), relations=True).property.where("name = 'relatedTo'")
    .select("feature_id", "val_feature_id"))


def crossing(m):
    """Items that also use their order's geometry, in another LoD; for every third order the holder is LoD 4."""
    lod = F.when(F.shiftright("feature_id", 6) % 3 == 0, "4").otherwise(F.col("val_lod"))
    rows = m.property.withColumn("val_lod", F.when((F.col("name") == "geometry") & (F.col("feature_id") % 64 == 0), lod)
                                 .otherwise(F.col("val_lod")))
    extra = m.property.where("name = 'geometry' and feature_id % 64 between 1 and 8").withColumns({
        "id": F.col("id") + 400, "name": F.lit("outline"), "val_geometry_id": F.shiftleft(F.shiftright("feature_id", 6), 6)})
    return m.replace(property=rows.unionByName(extra.select(*m.property.columns)))


query("resolve_cross_lod", """SELECT p.feature_id AS id, 1 AS copies FROM (SELECT feature_id // 64 AS k, min(feature_id) AS feature_id
      FROM property WHERE name = 'geometry' AND feature_id % 64 BETWEEN 1 AND 8 GROUP BY 1) p""")(
    lambda m: _cross_copies(m))


def _cross_copies(m):
    out = pp.resolve_cross_lod(crossing(m))
    new = out.geometry_data.join(m.geometry_data.select("id"), "id", "left_anti")
    return new.groupBy(F.col("feature_id").alias("id")).agg(F.count("*").alias("copies"))


query("remove_lod4_references", """SELECT id + 400 AS id FROM property WHERE name = 'geometry' AND feature_id % 64 BETWEEN 1 AND 8
    AND (feature_id // 64) % 3 <> 0""")(
    lambda m: pp.resolve_cross_lod(crossing(m), "remove_lod4").property.where("name = 'outline'").select("id"))
query("template_scope_top_level", """SELECT 'T_' || tid AS objectid, count(*) AS copies FROM (
      SELECT DISTINCT feature_id // 64 AS k, val_implicitgeom_id AS tid FROM property WHERE val_implicitgeom_id IS NOT NULL)
    GROUP BY 1""")(
    lambda m: pp.template_scope(m, "top_level_feature").implicit_geometry.groupBy("objectid").agg(
        F.count("*").alias("copies")))
query("template_scope_global", """SELECT 'T_' || (val_implicitgeom_id % 7) AS objectid, count(*) AS uses FROM property
    WHERE val_implicitgeom_id IS NOT NULL GROUP BY 1""")(lambda m: _global_templates(m))


def _global_templates(m):
    renamed = m.implicit_geometry.withColumn("objectid", F.concat(F.lit("T_"), F.col("id") % 7))
    out = pp.template_scope(m.replace(implicit_geometry=renamed), "global")
    used = out.property.where("val_implicitgeom_id is not null").select(F.col("val_implicitgeom_id").alias("id"))
    return used.join(out.implicit_geometry, "id").groupBy("objectid").agg(F.count("*").alias("uses"))


def relabelled(m):
    """LoD 0 of orders with an even key becomes LoD 4."""
    hit = (F.col("val_lod") == "0") & (F.shiftright("feature_id", 6) % 2 == 0)
    return m.replace(property=m.property.withColumn("val_lod", F.when(hit, "4").otherwise(F.col("val_lod"))))


query("upgrade_lods", f"""{tree()}, p AS (SELECT id, feature_id, CASE WHEN val_lod = '0' AND (feature_id // 64) % 2 = 0
        THEN '4' ELSE val_lod END AS lod FROM property WHERE val_lod IS NOT NULL),
    four AS (SELECT DISTINCT root_id FROM tree JOIN p ON p.feature_id = node_id WHERE lod = '4'),
    hit AS (SELECT DISTINCT node_id FROM tree WHERE root_id IN (SELECT root_id FROM four))
    SELECT id, CASE WHEN feature_id IN (SELECT node_id FROM hit) AND lod = '4' THEN '3' ELSE lod END AS val_lod FROM p
    WHERE NOT (feature_id IN (SELECT node_id FROM hit) AND lod = '3')""", recursive=True)(
    lambda m: pp.upgrade_lods(relabelled(m), m.feature.where("objectclass_id = 20").select("id")).property
    .where("val_lod is not null").select("id", "val_lod"))
query("upgrade_surfaces", """SELECT feature_id, 1 AS boundaries, 22 AS objectclass_id, val_geometry_id FROM property
    WHERE name = 'geometry' AND feature_id % 64 = 0""")(lambda m: _surfaces(m))


def _surfaces(m):
    edges = m.property.withColumn("name", F.when((F.col("name") == "geometry") & (F.col("feature_id") % 64 == 0),
                                                 "lod0RoofEdge").otherwise(F.col("name")))
    out = pp.upgrade_surfaces(m.replace(property=edges), "lod0RoofEdge", 22, "RS_")
    new = out.feature.join(m.feature.select("id"), "id", "left_anti").select(F.col("id").alias("new"), "objectclass_id")
    link = out.property.where("val_relation_type = 1").select("feature_id", F.col("val_feature_id").alias("new"))
    shape = out.property.where("val_geometry_id is not null").select(F.col("feature_id").alias("new"), "val_geometry_id")
    return link.join(new, "new").join(shape, "new").select(
        "feature_id", F.lit(1).alias("boundaries"), "objectclass_id", "val_geometry_id")


query("prune_group_members", """WITH removed AS (SELECT id FROM feature WHERE objectclass_id = 20 AND termination_date IS NOT NULL),
    kept AS (SELECT feature_id, val_feature_id FROM property WHERE name = 'order' AND val_feature_id NOT IN (SELECT id FROM removed))
    SELECT feature_id, count(*) AS members FROM kept GROUP BY 1""")(
    lambda m: _groups(m).property.where("name = 'order'").groupBy("feature_id").agg(F.count("*").alias("members")))
query("prune_empty_groups", """WITH removed AS (SELECT id FROM feature WHERE objectclass_id = 20 AND termination_date IS NOT NULL),
    owners AS (SELECT feature_id, bool_and(val_feature_id IN (SELECT id FROM removed)) AS emptied FROM property
      WHERE name = 'order' GROUP BY 1)
    SELECT id FROM feature WHERE objectclass_id = 10 AND id NOT IN (SELECT feature_id FROM owners WHERE emptied)""")(
    lambda m: _groups(m).feature.where("objectclass_id = 10").select("id"))


def _groups(m):
    removed = m.feature.where("objectclass_id = 20 and termination_date is not null").select("id")
    return pp.prune_group_members(m, removed, [10], member="order")
