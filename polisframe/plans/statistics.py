"""Content statistics."""

from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.operators import statistics as st
from polisframe.plans.registry import query

_ACTIVE = "termination_date IS NULL"
_TERMINATED = "termination_date IS NOT NULL"


for _scope, _where in (("all", "true"), ("active", _ACTIVE), ("terminated", _TERMINATED)):
    def _register(scope=_scope, where=_where):
        query(f"feature_count_{scope}", f"""
            SELECT objectclass_id, count(*) AS n FROM feature WHERE {where} GROUP BY 1""")(
            lambda m: st.feature_count(m, scope))
        query(f"feature_count_and_extent_{scope}", f"""
            SELECT objectclass_id, count(*) AS n, min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin,
              max(xmax) AS xmax, max(ymax) AS ymax, max(zmax) AS zmax
            FROM feature WHERE {where} GROUP BY 1""")(
            lambda m: st.feature_count_and_extent(m, scope).select("objectclass_id", "n", *env.fields("envelope")))
        query(f"feature_count_by_lod_{scope}", f"""
            SELECT val_lod, count(p.feature_id) AS n FROM property p JOIN feature f ON f.id = p.feature_id
            WHERE val_lod IS NOT NULL AND {where} GROUP BY 1""")(lambda m: st.feature_count_by_lod(m, scope))
        query(f"geometry_count_{scope}", f"""
            SELECT geometry_type, count(*) AS n FROM geometry_data g LEFT JOIN feature f ON f.id = g.feature_id
            WHERE {where} GROUP BY 1""")(lambda m: st.geometry_count(m, scope))
        query(f"geometry_count_by_lod_{scope}", f"""
            SELECT val_lod, count(val_geometry_id) AS n FROM property p JOIN feature f ON f.id = p.feature_id
            WHERE val_lod IS NOT NULL AND {where} GROUP BY 1""")(lambda m: st.geometry_count_by_lod(m, scope))
        query(f"lods_{scope}", f"""
            SELECT DISTINCT val_lod FROM property p JOIN feature f ON f.id = p.feature_id
            WHERE val_lod IS NOT NULL AND {where}""")(lambda m: st.lods(m, scope))
        query(f"appearance_count_by_theme_{scope}", f"""
            SELECT coalesce(theme, '<none>') AS theme, count(*) AS n
            FROM appearance a LEFT JOIN feature f ON f.id = a.feature_id WHERE {where} GROUP BY 1""")(
            lambda m: st.appearance_count_by_theme(m, scope))
        query(f"themes_{scope}", f"""
            SELECT DISTINCT coalesce(theme, '<none>') AS theme
            FROM appearance a LEFT JOIN feature f ON f.id = a.feature_id WHERE {where}""")(
            lambda m: st.themes(m, scope))
        query(f"surface_data_flags_{scope}", f"""
            SELECT coalesce(bool_or(material), false) AS has_materials, coalesce(bool_or(texture), false) AS has_textures,
              coalesce(bool_or(georeferenced), false) AS has_georeferenced
            FROM surface_data_mapping s LEFT JOIN geometry_data g ON g.id = s.geometry_data_id
            LEFT JOIN feature f ON f.id = g.feature_id WHERE {where}""")(lambda m: st.surface_data_flags(m, scope))
        query(f"surface_data_count_{scope}", f"""
            SELECT objectclass_id, count(*) AS n FROM surface_data WHERE {'true' if scope == 'all' else f'''id IN (
              SELECT surface_data_id FROM surface_data_mapping s JOIN geometry_data g ON g.id = s.geometry_data_id
              LEFT JOIN feature f ON f.id = g.feature_id WHERE {where})'''} GROUP BY 1""")(
            lambda m: st.surface_data_count(m, scope))
        query(f"generic_attributes_{scope}", f"""
            SELECT DISTINCT objectclass_id, name, datatype_id
            FROM property p JOIN feature f ON f.id = p.feature_id WHERE namespace_id = 3 AND {where}""")(
            lambda m: st.generic_attributes(m, scope))
        query(f"address_count_{scope}", f"""
            SELECT count(id) AS n FROM address WHERE {'true' if scope == 'all' else f'''id IN (
              SELECT val_address_id FROM property p JOIN feature f ON f.id = p.feature_id WHERE {where})'''}""")(
            lambda m: st.address_count(m, scope))
    _register()

query("implicit_geometry_count", "SELECT count(*) AS n FROM implicit_geometry")(st.implicit_geometry_count)
query("has_global_appearances", """
    SELECT count(*) > 0 AS has_global FROM appearance WHERE feature_id IS NULL AND implicit_geometry_id IS NULL""")(
    st.has_global_appearances)
query("codelist_summary", "SELECT DISTINCT codelist_type, url FROM codelist")(st.codelist_summary)
query("codelist_urls_by_type", """
    SELECT codelist_type, count(DISTINCT url) AS n FROM codelist GROUP BY 1""")(
    lambda m: st.codelist_summary(m).groupBy("codelist_type").agg(F.count("*").alias("n")))
query("distinct_lods_per_feature", """
    SELECT lods, count(*) AS features FROM (
      SELECT feature_id, count(DISTINCT val_lod) AS lods FROM property GROUP BY 1) GROUP BY 1""")(
    lambda m: st.distinct_lods_per_feature(m).groupBy("lods").agg(F.count("*").alias("features")))

# catalogue tables have the rows that the rules of the derived model name, code lists an entry a nation
_SIZED = ("feature", "property", "geometry_data", "implicit_geometry", "address", "appearance", "tex_image", "surface_data", "surface_data_mapping",
          "appear_to_surface_data", "codelist", "objectclass", "feature_changelog")
query("table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _SIZED) + """
    UNION ALL SELECT 'ade', 1 UNION ALL SELECT 'namespace', 3 UNION ALL SELECT 'datatype', 15 UNION ALL SELECT 'codelist_entry', count(*) FROM nation"""
      )(lambda m: st.table_sizes(m))


def _debtors_gone(m):
    """The model after the customers with a negative balance are terminated, so that appearances have terminated owners."""
    gone = m.property.where("name = 'balance' and val_double < 0").select(F.col("feature_id").alias("id"), F.lit(True).alias("gone"))
    out = m.feature.join(gone, "id", "left").withColumn("termination_date", F.when(F.col("gone"), F.lit("2024-01-01").cast("timestamp")).otherwise(F.col("termination_date")))
    return m.replace(feature=out.select(*m.feature.columns))


_GONE = "appearance a JOIN property p ON p.feature_id = a.feature_id AND p.name = 'balance' AND p.val_double < 0"
query("appearance_count_by_theme_debtors", f"SELECT coalesce(theme, '<none>') AS theme, count(*) AS n FROM {_GONE} GROUP BY 1")(
    lambda m: st.appearance_count_by_theme(_debtors_gone(m), "terminated"))
query("themes_debtors", f"SELECT DISTINCT coalesce(theme, '<none>') AS theme FROM {_GONE}")(lambda m: st.themes(_debtors_gone(m), "terminated"))
query("type_summary", """
    SELECT 'own:' || classname AS type_name, count(*) AS n FROM feature f JOIN objectclass c ON c.id = objectclass_id
    GROUP BY 1""")(lambda m: st.type_summary(m, m.feature))

_FEATURES = """
    SELECT 'terminated_features' AS section, classname AS key, count(*) AS value FROM feature f
    JOIN objectclass c ON c.id = objectclass_id WHERE termination_date IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'active_features', classname, count(*) FROM feature f
    JOIN objectclass c ON c.id = objectclass_id WHERE termination_date IS NULL GROUP BY 2"""
query("model_report_compact", f"""{_FEATURES}
    UNION ALL SELECT DISTINCT 'lods', val_lod, 1 FROM property p JOIN feature f ON f.id = p.feature_id
    WHERE val_lod IS NOT NULL AND termination_date IS NULL
    UNION ALL SELECT DISTINCT 'appearances', coalesce(theme, '<none>'), 1
    FROM appearance a LEFT JOIN feature f ON f.id = a.feature_id WHERE termination_date IS NULL""")(
    lambda m: st.model_report(m, compact=True))
query("model_report", f"""{_FEATURES}
    UNION ALL SELECT 'geometries', CAST(geometry_type AS VARCHAR), count(*) FROM geometry_data g
    JOIN feature f ON f.id = g.feature_id WHERE termination_date IS NULL GROUP BY 2
    UNION ALL SELECT 'implicit_geometries', 'count', count(*) FROM implicit_geometry
    UNION ALL SELECT 'lods', val_lod, count(val_geometry_id) FROM property p JOIN feature f ON f.id = p.feature_id
    WHERE val_lod IS NOT NULL AND termination_date IS NULL GROUP BY 2
    UNION ALL SELECT 'appearances', coalesce(theme, '<none>'), count(*)
    FROM appearance a LEFT JOIN feature f ON f.id = a.feature_id WHERE termination_date IS NULL GROUP BY 2
    UNION ALL SELECT 'surface_data', kind, CAST(present AS INTEGER) FROM (
      SELECT unnest(['materials', 'textures', 'georeferenced']) AS kind,
        unnest([bool_or(material), bool_or(texture), bool_or(georeferenced)]) AS present
      FROM surface_data_mapping s JOIN geometry_data g ON g.id = s.geometry_data_id
      LEFT JOIN feature f ON f.id = g.feature_id WHERE termination_date IS NULL)
    UNION ALL SELECT 'global_appearances', 'present', CAST(count(*) > 0 AS INTEGER) FROM appearance
    WHERE feature_id IS NULL
    UNION ALL SELECT 'addresses', 'count', count(*) FROM address WHERE id IN (
      SELECT val_address_id FROM property p JOIN feature f ON f.id = p.feature_id WHERE termination_date IS NULL)
    UNION ALL SELECT 'extensions', 'trade 1.0', 1
    UNION ALL SELECT DISTINCT 'codelists', codelist_type || ' ' || url, 1 FROM codelist
    UNION ALL SELECT DISTINCT 'generic_attributes', classname || '.' || name, datatype_id
    FROM property p JOIN feature f ON f.id = p.feature_id JOIN objectclass c ON c.id = objectclass_id
    WHERE namespace_id = 3 AND termination_date IS NULL""")(
    lambda m: st.model_report(m, generic=True))
