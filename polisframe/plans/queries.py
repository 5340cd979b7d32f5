"""Type selection, property paths, comparison, validity, sorting and paging."""

import datetime as dt

from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions import scalar as s
from polisframe.functions import temporal as tm
from polisframe.operators import query as oq
from polisframe.operators.query import FeatureQuery, Step
from polisframe.plans.registry import query
from polisframe.runtime import local_frame


def fmt(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# -- types and projection

query("query_columns", """SELECT id, objectclass_id, objectid, strftime(creation_date, '%Y-%m-%d %H:%M:%S') AS creation_date
    FROM feature WHERE objectclass_id IN (10, 11, 20, 30)""")(
    lambda m: FeatureQuery(m).result("objectid", "creation_date").select(
        "id", "objectclass_id", "objectid", fmt("creation_date")))
query("of_types_abstract", "SELECT id, objectclass_id FROM feature WHERE objectclass_id IN (10, 11)")(
    lambda m: FeatureQuery(m, ["AbstractParty"]).result())
query("of_types_concrete", "SELECT id, objectclass_id FROM feature WHERE objectclass_id IN (20, 21)")(
    lambda m: FeatureQuery(m, ["own:Order", "orderitem"]).result())
query("of_types_root", """WITH t AS (SELECT c.id FROM objectclass c WHERE is_abstract = 0 AND id < 40)
    SELECT objectclass_id, count(*) AS n FROM feature WHERE objectclass_id IN (SELECT id FROM t) GROUP BY 1""")(
    lambda m: FeatureQuery(m, ["AbstractObject"]).result().groupBy("objectclass_id").agg(F.count("*").alias("n")))
query("top_level", "SELECT id FROM feature f JOIN objectclass c ON c.id = objectclass_id WHERE is_toplevel = 1"
      .replace("SELECT id", "SELECT f.id"))(lambda m: FeatureQuery(m).result().select("id"))
query("common_supertype", """SELECT f.id, 'AbstractParty' AS supertype FROM feature f WHERE objectclass_id IN (10, 11)""")(
    lambda m: FeatureQuery(m, ["Customer", "Supplier"]).result().select(
        "id", F.lit(m.types.common_supertype(["Customer", "Supplier"])["classname"]).alias("supertype")))
query("subtype_closure", """WITH closure AS (SELECT id AS ancestor, id FROM objectclass
    UNION SELECT closure.ancestor, c.id FROM closure JOIN objectclass c ON c.superclass_id = closure.id)
    SELECT a.classname AS ancestor, count(*) AS n FROM closure JOIN objectclass a ON a.id = closure.ancestor
    JOIN feature f ON f.objectclass_id = closure.id GROUP BY 1""", recursive=True)(
    lambda m: m.feature.select("objectclass_id").join(
        local_frame(m.spark, [(a["classname"], c["id"]) for c in m.types.classes.values()
                                 for a in m.types.ancestors(c["id"])], "ancestor string, objectclass_id int"),
        "objectclass_id").groupBy("ancestor").agg(F.count("*").alias("n")))
query("lookup_type", "SELECT classname, count(*) AS n FROM feature f JOIN objectclass c ON c.id = objectclass_id "
                     "WHERE lower(classname) IN ('customer', 'part') GROUP BY 1")(
    lambda m: m.feature.where(F.col("objectclass_id").isin(
        [m.types.lookup("CUSTOMER")["id"], m.types.lookup("own:Part")["id"]]))
    .join(m.objectclass.select(F.col("id").alias("objectclass_id"), "classname"), "objectclass_id")
    .groupBy("classname").agg(F.count("*").alias("n")))


# -- paths

def _q(m, types, build):
    q = FeatureQuery(m, types)
    conditions = build(q)
    return q.where(*conditions) if isinstance(conditions, tuple) else q.where(conditions)


query("path_declared", """SELECT id, objectclass_id FROM feature WHERE id IN (SELECT feature_id FROM property
    WHERE name = 'priority' AND val_string = '1-URGENT')""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path("priority"), "=", "1-URGENT")).result())
query("path_inherited", """SELECT id FROM feature WHERE objectclass_id IN (10, 11) AND id IN (
    SELECT feature_id FROM property WHERE name = 'balance' AND val_double > 5000)""")(
    lambda m: _q(m, ["AbstractParty"], lambda q: s.compare(q.path("balance"), ">", 5000)).result().select("id"))
query("path_nested", """SELECT p.feature_id AS id FROM property p JOIN property c ON c.parent_id = p.id
    WHERE p.name = 'dims' AND c.name = 'size' AND c.val_int >= 40""")(
    lambda m: _q(m, ["Part"], lambda q: s.compare(q.path("dims.size"), ">=", 40)).result().select("id"))
query("path_two_nested", """SELECT p.feature_id AS id FROM property p JOIN property c ON c.parent_id = p.id
    JOIN property d ON d.parent_id = p.id WHERE p.name = 'dims' AND c.name = 'size' AND c.val_int < 10
    AND d.name = 'type' AND d.val_string = 'SMALL'""")(
    lambda m: _q(m, ["Part"], lambda q: (s.compare(q.path("dims.size"), "<", 10),
                                         s.compare(q.path("dims.type"), "=", "SMALL"))).result().select("id"))
query("path_subfeature", """SELECT DISTINCT e.feature_id AS id FROM property e JOIN property v
    ON v.feature_id = e.val_feature_id WHERE e.name = 'item' AND v.name = 'quantity' AND v.val_double >= 49""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path("item.quantity"), ">=", 49.0)).result().select("id"))
query("path_shared_supplier", """SELECT DISTINCT i.feature_id AS id FROM property i
    JOIN property su ON su.feature_id = i.val_feature_id AND su.name = 'supplier'
    JOIN property n ON n.feature_id = su.val_feature_id AND n.name = 'nation'
    WHERE i.name = 'item' AND n.val_int = 7""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path("item.supplier.nation"), "=", 7)).result().select("id"))
query("path_boundary_class", """SELECT DISTINCT e.feature_id AS id FROM property e JOIN feature t
    ON t.id = e.val_feature_id AND t.objectclass_id = 22 WHERE e.name = 'boundary' AND t.termination_date IS NOT NULL""")(
    lambda m: m.property.where("name = 'boundary'").join(
        m.feature.where("objectclass_id = 22 and termination_date is not null").select(
            F.col("id").alias("val_feature_id")), "val_feature_id").select(F.col("feature_id").alias("id")).distinct())
query("generic_default_string", """SELECT DISTINCT feature_id AS id FROM property WHERE name = 'flag' AND val_string = 'R'""")(
    lambda m: _q(m, ["OrderItem"], lambda q: s.compare(q.path("flag"), "=", "R")).result().select("id"))
query("cast_path", """SELECT DISTINCT feature_id AS id FROM property WHERE name = 'flag' AND val_string < 'N'""")(
    lambda m: _q(m, ["OrderItem"], lambda q: s.compare(q.path(Step("flag", cast="string")), "<", "N"))
    .result().select("id"))
query("step_predicate", """SELECT DISTINCT e.feature_id AS id FROM property e JOIN property v
    ON v.feature_id = e.val_feature_id WHERE e.name = 'item' AND e.val_relation_type = 1 AND v.name = 'quantity'
    AND v.id % 1000 > 140 AND v.val_double < 45""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path(
        Step("item", where=lambda p: p("val_relation_type") == 1),
        Step("quantity", where=lambda p: p("id") % 1000 > 140)), "<", 45)).result().select("id"))
query("positional_step", """SELECT feature_id AS id FROM (SELECT feature_id, val_double,
      row_number() OVER (PARTITION BY feature_id ORDER BY id) AS rn FROM property WHERE name = 'quantity')
    WHERE rn = 2 AND val_double > 30""")(
    lambda m: _q(m, ["OrderItem"], lambda q: s.compare(q.path(Step("quantity", at=2)), ">", 30)).result().select("id"))
query("positional_first_item", """SELECT i.feature_id AS id FROM (SELECT feature_id, val_feature_id,
      row_number() OVER (PARTITION BY feature_id ORDER BY id) AS rn FROM property WHERE name = 'item') i
    JOIN property v ON v.feature_id = i.val_feature_id AND v.name = 'quantity'
    WHERE rn = 1 AND v.val_double = 7""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path(Step("item", at=1), "quantity"), "=", 7)).result().select("id"))
query("positional_zero", "SELECT id FROM feature WHERE false")(
    lambda m: _q(m, ["OrderItem"], lambda q: s.compare(q.path(Step("quantity", at=0)), ">", 0)).result().select("id"))
query("nth_property", """SELECT feature_id, id, val_double FROM (SELECT *,
      row_number() OVER (PARTITION BY feature_id ORDER BY id) AS rn FROM property WHERE name = 'quantity')
    WHERE rn = 3""")(
    lambda m: oq.nth_property(m.property, "quantity", 3).select("feature_id", "id", "val_double"))
query("shared_binding", """SELECT DISTINCT feature_id AS id FROM property WHERE name = 'quantity'
    AND val_double > 20 AND val_double < 30""")(
    lambda m: _q(m, ["OrderItem"], lambda q: (s.compare(q.path("quantity"), ">", 20),
                                              s.compare(q.path("quantity"), "<", 30))).result().select("id"))
query("shared_binding_never", "SELECT id FROM feature WHERE false")(
    lambda m: _q(m, ["OrderItem"], lambda q: (s.compare(q.path("flag"), "=", "A"),
                                              s.compare(q.path("flag"), "=", "N"))).result().select("id"))
query("or_across_paths", """SELECT f.id FROM feature f WHERE objectclass_id = 20 AND (
      EXISTS (SELECT 1 FROM property p WHERE p.feature_id = f.id AND name = 'priority' AND val_string = '5-LOW')
      OR EXISTS (SELECT 1 FROM property p WHERE p.feature_id = f.id AND name = 'price' AND val_double > 400000))""")(
    lambda m: _q(m, ["Order"], lambda q: s.any_of(s.compare(q.path("priority"), "=", "5-LOW"),
                                                  s.compare(q.path("price"), ">", 400000))).result().select("id"))
query("count_hits", """SELECT count(DISTINCT e.feature_id) AS hits FROM property e JOIN property v
    ON v.feature_id = e.val_feature_id WHERE e.name = 'item' AND v.name = 'quantity' AND v.val_double > 25""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path("item.quantity"), ">", 25)).count_hits())
query("query_extent", """SELECT min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax,
    max(ymax) AS ymax, max(zmax) AS zmax FROM feature WHERE id IN (
      SELECT feature_id FROM property WHERE name = 'priority' AND val_string = '3-MEDIUM')""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path("priority"), "=", "3-MEDIUM")).extent()
    .select(*env.fields("envelope")))
query("two_hop_join", """SELECT o.val_feature_id AS order_id, p.val_string AS priority, s.val_string AS segment
    FROM property o JOIN property p ON p.feature_id = o.val_feature_id AND p.name = 'priority'
    JOIN property s ON s.feature_id = o.feature_id AND s.name = 'segment' WHERE o.name = 'order'""")(
    lambda m: m.property.where("name = 'order'").select(F.col("feature_id").alias("c"), F.col("val_feature_id").alias("order_id"))
    .join(m.property.where("name = 'priority'").select(F.col("feature_id").alias("order_id"),
                                                       F.col("val_string").alias("priority")), "order_id")
    .join(m.property.where("name = 'segment'").select(F.col("feature_id").alias("c"),
                                                      F.col("val_string").alias("segment")), "c")
    .select("order_id", "priority", "segment"))


# -- comparison, logic, arithmetic, text

_PRICE = "SELECT feature_id AS id FROM property WHERE name = 'price' AND {}"
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    def _cmp(name=_name, op=_op):
        query(f"compare_{name}", f"SELECT feature_id AS id FROM property WHERE name = 'nation' "
                                 f"AND feature_id % 64 = 60 AND val_int {op} 12")(
            lambda m: _q(m, ["Customer"], lambda q: s.compare(q.path("nation"), op, 12)).result().select("id"))
    _cmp()
query("between", _PRICE.format("val_double BETWEEN 100000 AND 200000"))(
    lambda m: _q(m, ["Order"], lambda q: s.between(q.path("price"), 100000, 200000)).result().select("id"))
query("not_between", _PRICE.format("val_double NOT BETWEEN 100000 AND 200000"))(
    lambda m: _q(m, ["Order"], lambda q: s.between(q.path("price"), 100000, 200000, negate=True)).result().select("id"))
query("in_list", "SELECT feature_id AS id FROM property WHERE name = 'segment' AND val_string IN ('MACHINERY', 'FURNITURE')")(
    lambda m: _q(m, ["Customer"], lambda q: s.in_list(q.path("segment"), ["MACHINERY", "FURNITURE"])).result().select("id"))
query("not_in_list", "SELECT feature_id AS id FROM property WHERE name = 'segment' AND val_string NOT IN ('MACHINERY', 'FURNITURE')")(
    lambda m: _q(m, ["Customer"], lambda q: s.in_list(q.path("segment"), ["MACHINERY", "FURNITURE"], negate=True))
    .result().select("id"))
query("in_list_mixed_numbers", "SELECT feature_id AS id FROM property WHERE name = 'nation' AND feature_id % 64 = 60 "
                               "AND val_int IN (3, 7)")(
    lambda m: _q(m, ["Customer"], lambda q: s.in_list(q.path("nation"), [3, 7.0, 9.5])).result().select("id"))
query("is_null_value", "SELECT id FROM feature WHERE objectclass_id = 20 AND valid_from IS NULL")(
    lambda m: _q(m, ["Order"], lambda q: q.is_null("validFrom")).result().select("id"))
query("is_not_null_value", "SELECT id FROM feature WHERE objectclass_id = 20 AND valid_from IS NOT NULL")(
    lambda m: _q(m, ["Order"], lambda q: ~q.is_null("validFrom")).result().select("id"))
query("is_null_uom", "SELECT feature_id AS id FROM property WHERE name = 'balance' AND feature_id % 64 = 60")(
    lambda m: m.property.where((F.col("name") == "balance") & F.col("val_uom").isNull() &
                               (F.col("feature_id") % 64 == 60)).select(F.col("feature_id").alias("id")))
query("is_null_rows", """SELECT id FROM feature f WHERE objectclass_id = 20 AND NOT EXISTS (
    SELECT 1 FROM property p WHERE p.feature_id = f.id AND name = 'item')""")(
    lambda m: _q(m, ["Order"], lambda q: q.missing("item")).result().select("id"))
query("is_not_null_rows", """SELECT id FROM feature f WHERE objectclass_id = 20 AND EXISTS (
    SELECT 1 FROM property p WHERE p.feature_id = f.id AND name = 'item')""")(
    lambda m: _q(m, ["Order"], lambda q: q.present("item")).result().select("id"))
query("like", "SELECT feature_id AS id FROM property WHERE name = 'priority' AND val_string LIKE '%_E%'")(
    lambda m: _q(m, ["Order"], lambda q: s.like(q.path("priority"), "%_E%")).result().select("id"))
query("not_like", "SELECT feature_id AS id FROM property WHERE name = 'priority' AND val_string NOT LIKE '%URG%'")(
    lambda m: _q(m, ["Order"], lambda q: s.like(q.path("priority"), "%URG%", negate=True)).result().select("id"))
query("like_escape", r"SELECT id FROM feature WHERE objectclass_id = 21 AND objectid LIKE 'I\_%\_3' ESCAPE '\'")(
    lambda m: _q(m, ["OrderItem"], lambda q: s.like(q.path("objectId"), r"I\_%\_3")).result().select("id"))
query("not_around_and", """SELECT p.feature_id AS id FROM property p JOIN property r ON r.feature_id = p.feature_id
    WHERE p.name = 'price' AND r.name = 'priority' AND NOT (p.val_double > 100000 AND r.val_string = '2-HIGH')""")(
    lambda m: _q(m, ["Order"], lambda q: s.negate(s.all_of(
        s.compare(q.path("price"), ">", 100000), s.compare(q.path("priority"), "=", "2-HIGH")))).result().select("id"))
query("and_or_not", """SELECT p.feature_id AS id FROM property p JOIN property n ON n.feature_id = p.feature_id
    WHERE p.name = 'balance' AND n.name = 'nation' AND p.feature_id % 64 = 60
    AND ((p.val_double < 0 OR n.val_int = 3) AND NOT n.val_int = 5)""")(
    lambda m: _q(m, ["Customer"], lambda q: s.all_of(
        s.any_of(s.compare(q.path("balance"), "<", 0), s.compare(q.path("nation"), "=", 3)),
        s.negate(s.compare(q.path("nation"), "=", 5)))).result().select("id"))

_NATION = "SELECT feature_id AS id FROM property WHERE name = 'nation' AND feature_id % 64 = 60 AND {}"


def _nation(name, sql, build):
    query(name, _NATION.format(sql))(
        lambda m: _q(m, ["Customer"], lambda q: build(q.path("nation"))).result().select("id"))


_nation("arithmetic_add_multiply", "val_int * 2 + 1 > 30",
        lambda n: s.compare(s.arithmetic(s.arithmetic(n, "*", 2), "+", 1), ">", 30))
_nation("arithmetic_subtract", "10 - val_int >= 4", lambda n: s.compare(s.arithmetic(10, "-", n), ">=", 4))
_nation("integer_division", "val_int // 5 = 2", lambda n: s.compare(s.arithmetic(n, "/", 5), "=", 2))
_nation("integer_division_negative", "CAST(trunc((val_int - 20) / 7.0::DOUBLE) AS BIGINT) = -1",
        lambda n: s.compare(s.arithmetic(s.arithmetic(n, "-", 20), "/", 7), "=", -1))
_nation("double_division", "val_int / 4.0::DOUBLE > 5.1", lambda n: s.compare(s.arithmetic(n, "/", 4.0), ">", 5.1))
_nation("modulo_sign", "(val_int - 20) % 3 = -1",
        lambda n: s.compare(s.arithmetic(s.arithmetic(n, "-", 20), "%", 3), "=", -1))
_nation("power", "pow(val_int, 2) > 300", lambda n: s.compare(s.arithmetic(n, "^", 2), ">", 300.0))
_nation("unary_minus", "-val_int < -20", lambda n: s.compare(s.minus(n), "<", -20))
_nation("implicit_casts", "val_int = 12", lambda n: s.compare(n, "=", "12"))
query("div_double", _PRICE.format("trunc(val_double / 1000.5::DOUBLE) = 100"))(
    lambda m: _q(m, ["Order"], lambda q: s.compare(s.arithmetic(q.path("price"), "div", 1000.5), "=", 100.0))
    .result().select("id"))
query("casei", "SELECT feature_id AS id FROM property WHERE name = 'segment' AND lower(val_string) = 'machinery'")(
    lambda m: _q(m, ["Customer"], lambda q: s.compare(s.casei(q.path("segment")), "=", s.casei("MachiNery")))
    .result().select("id"))
query("accenti", """SELECT p.feature_id AS id FROM property p WHERE name = 'segment' AND
    replace(replace(val_string, 'U', 'Ü'), 'E', 'É') IN (SELECT 'FÜRNITÜRÉ')""")(
    lambda m: _q(m, ["Customer"], lambda q: s.compare(
        s.accenti(s.Operand(F.translate(q.path("segment").column, "UE", "ÜÉ"), "string")), "=", "FURNITURE"))
    .result().select("id"))
query("upper", "SELECT DISTINCT upper(val_string) AS v FROM property WHERE name = 'type'")(
    lambda m: m.property.where("name = 'type'").select(
        s.upper(s.Operand(F.lower("val_string"), "string")).column.alias("v")).distinct())
query("timestamp_vs_date", """SELECT id FROM feature WHERE objectclass_id = 20
    AND CAST(creation_date AS DATE) = DATE '1998-10-03'""")(
    lambda m: _q(m, ["Order"], lambda q: s.compare(q.path("creationDate"), "=", dt.date(1998, 10, 3)))
    .result().select("id"))
query("sql_filter", """SELECT id, objectclass_id FROM feature WHERE objectclass_id = 10 AND id IN (
    SELECT feature_id FROM property WHERE name = 'balance' AND val_double > 9000)""")(
    lambda m: FeatureQuery(m, ["Customer"]).sql(
        "select feature_id from property where name = 'balance' and val_double > 9000").result())
query("in_ids", """SELECT p.id, p.name FROM property p JOIN (SELECT feature_id FROM property WHERE name = 'price' AND val_double > 490000) USING (feature_id)""")(
    lambda m: oq.in_ids(m.property, m.property.where("name = 'price' and val_double > 490000").select("feature_id"),
                        "feature_id").select("id", "name"))
query("convert_length", "SELECT id, round(zmax / 0.3048::DOUBLE, 6) AS height_ft FROM feature WHERE zmax IS NOT NULL")(
    lambda m: m.feature.where("envelope.zmax is not null").select(
        "id", F.round(F.col("envelope.zmax") / s.convert_length(1.0, "ft"), 6).alias("height_ft")))


# -- boxes

query("bbox_intersects", "SELECT id FROM feature WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 300 AND ymax >= 100")(
    lambda m: m.feature.where(env.intersects_2d("envelope", env.box(100, 100, 300, 300))).select("id"))
query("bbox_disjoint", "SELECT id FROM feature WHERE xmin > 300 OR xmax < 100 OR ymin > 300 OR ymax < 100")(
    lambda m: m.feature.where(env.disjoint_2d("envelope", env.box(100, 100, 300, 300))).select("id"))
query("bbox_3d", """SELECT id FROM feature WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 300 AND ymax >= 100
    AND (zmin IS NULL OR (zmin <= 20 AND zmax >= 8))""")(
    lambda m: m.feature.where(env.intersects("envelope", env.box(100, 100, 8, 300, 300, 20))).select("id"))
query("bbox_contains", "SELECT id FROM feature WHERE xmin >= 100 AND xmax <= 300 AND ymin >= 100 AND ymax <= 300")(
    lambda m: m.feature.where(env.contains(env.box(100, 100, 300, 300), F.col("envelope"))).select("id"))
query("bbox_within", "SELECT id FROM feature WHERE xmin > 100 AND xmax < 300 AND ymin > 100 AND ymax < 300")(
    lambda m: m.feature.where(env.within("envelope", env.box(100, 100, 300, 300))).select("id"))
query("bbox_contains_point", "SELECT id FROM feature WHERE xmin <= 100 AND xmax >= 100 AND ymin <= 100.5 AND ymax >= 100.5")(
    lambda m: m.feature.where(env.contains_point("envelope", F.lit(100.0), F.lit(100.5))).select("id"))
query("bbox_contains_point_inside", "SELECT id FROM feature WHERE xmin <= 888 AND xmax >= 888 AND ymin <= 62 AND ymax >= 62")(
    lambda m: m.feature.where(env.contains_point("envelope", F.lit(888.0), F.lit(62.0))).select("id"))
query("envelope_center", "SELECT id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (zmin + zmax) / 2 AS cz "
                         "FROM feature WHERE xmin IS NOT NULL")(
    lambda m: m.feature.where("envelope is not null").select(
        "id", env.center("envelope").x.alias("cx"), env.center("envelope").y.alias("cy"),
        env.center("envelope").z.alias("cz")))
query("envelope_include", """SELECT id, least(xmin, 5.0) AS xmin, least(ymin, 5.0) AS ymin, greatest(xmax, 500.0) AS xmax,
    greatest(ymax, 500.0) AS ymax FROM (SELECT id, coalesce(xmin, 5) xmin, coalesce(ymin, 5) ymin,
    coalesce(xmax, 500) xmax, coalesce(ymax, 500) ymax FROM feature WHERE objectclass_id = 10)""")(
    lambda m: m.feature.where("objectclass_id = 10").select(
        "id", env.include("envelope", env.box(5, 5, 500, 500)).alias("e")).select("id", "e.xmin", "e.ymin", "e.xmax", "e.ymax"))
query("envelope_polygon", """SELECT id, 5 AS points, xmin AS x0, ymin AS y0, xmax AS x2, ymax AS y2,
    CASE WHEN zmin IS NULL THEN 2 ELSE 3 END AS dims FROM feature WHERE xmin IS NOT NULL""")(
    lambda m: m.feature.where("envelope is not null").select("id", env.to_polygon("envelope").alias("r")).select(
        "id", F.size(F.col("r")[0]).alias("points"), F.col("r")[0][0][0].alias("x0"), F.col("r")[0][0][1].alias("y0"),
        F.col("r")[0][2][0].alias("x2"), F.col("r")[0][2][1].alias("y2"), F.size(F.col("r")[0][0]).alias("dims")))
query("envelope_force_2d", "SELECT id, xmin, xmax, CAST(NULL AS DOUBLE) AS zmin FROM feature WHERE xmin IS NOT NULL")(
    lambda m: m.feature.where("envelope is not null").select("id", env.force_2d("envelope").alias("e")).select(
        "id", "e.xmin", "e.xmax", "e.zmin"))


# -- validity

_AT = dt.datetime(1998, 1, 1)
for _ref, _from, _to in (("database", "creation_date", "termination_date"), ("real_world", "valid_from", "valid_to")):
    def _time(ref=_ref, start=_from, end=_to):
        sql = "SELECT id FROM feature WHERE objectclass_id IN (20, 21) AND {}".format
        rows = lambda m: m.feature.where("objectclass_id in (20, 21)")
        at = "TIMESTAMP '1998-01-01'"
        query(f"valid_{ref}", sql(f"{end} IS NULL"))(lambda m: rows(m).where(tm.valid(ref)).select("id"))
        query(f"invalid_{ref}", sql(f"{end} IS NOT NULL"))(lambda m: rows(m).where(tm.invalid(ref)).select("id"))
        query(f"valid_at_{ref}", sql(f"{start} <= {at} AND ({end} IS NULL OR {end} > {at})"))(
            lambda m: rows(m).where(tm.valid_at(_AT, ref)).select("id"))
        query(f"valid_at_lenient_{ref}", sql(f"({start} IS NULL OR {start} <= {at}) AND ({end} IS NULL OR {end} > {at})"))(
            lambda m: rows(m).where(tm.valid_at(_AT, ref, lenient=True)).select("id"))
        query(f"invalid_at_{ref}", sql(f"{end} <= {at}"))(lambda m: rows(m).where(tm.invalid_at(_AT, ref)).select("id"))
    _time()
query("default_validity", "SELECT id FROM feature WHERE objectclass_id IN (10, 11, 20, 30) AND termination_date IS NULL")(
    lambda m: FeatureQuery(m).valid().result().select("id"))
query("validity_all", "SELECT id FROM feature WHERE objectclass_id IN (10, 11, 20, 30)")(
    lambda m: FeatureQuery(m).valid("all").result().select("id"))


# -- sorting and paging

query("flagship", """SELECT f.id, f.objectid, strftime(creation_date, '%Y-%m-%d %H:%M:%S') AS creation_date,
      (SELECT count(*) FROM property i WHERE i.feature_id = f.id AND i.name = 'item') AS items
    FROM feature f JOIN property p ON p.feature_id = f.id AND p.name = 'priority'
    WHERE objectclass_id = 20 AND termination_date IS NULL AND p.val_string IN ('1-URGENT', '2-HIGH')
      AND xmin <= 600 AND xmax >= 100 AND ymin <= 600 AND ymax >= 100
    ORDER BY f.creation_date NULLS LAST, f.id LIMIT 20""")(lambda m: flagship(m))


def flagship(m):
    """Valid orders of two priorities meeting a box, by date, first 20, with their item count."""
    q = FeatureQuery(m, ["Order"])
    q.where(s.in_list(q.path("priority"), ["1-URGENT", "2-HIGH"]),
            env.intersects_2d("envelope", env.box(100, 100, 600, 600)))
    page = q.valid().sort_by(("creationDate", "asc")).page(20).result("objectid", "creation_date")
    items = m.property.where("name = 'item'").groupBy(F.col("feature_id").alias("id")).agg(F.count("*").alias("items"))
    return page.join(items, "id", "left").select(
        "id", "objectid", fmt("creation_date"), F.coalesce("items", F.lit(0)).alias("items"))


query("sort_asc_nulls_last", """SELECT id, row_number() OVER (ORDER BY valid_from ASC NULLS LAST, id) AS pos
    FROM feature WHERE objectclass_id = 20 QUALIFY pos <= 500""")(
    lambda m: oq.sequenced(FeatureQuery(m, ["Order"]).sort_by(("validFrom", "asc")).page(500).result("valid_from"),
                           [F.col("valid_from").asc_nulls_last(), F.col("id")], "pos").select("id", "pos"))
query("sort_desc_nulls_first", """SELECT id FROM feature WHERE objectclass_id = 20
    ORDER BY valid_from DESC NULLS FIRST, id LIMIT 3000""")(
    lambda m: FeatureQuery(m, ["Order"]).sort_by(("validFrom", "desc")).page(3000).result().select("id"))
query("sort_multi_valued", """SELECT id FROM (SELECT f.id, min(p.val_double) AS v FROM feature f
      LEFT JOIN property p ON p.feature_id = f.id AND p.name = 'quantity' WHERE objectclass_id = 21 GROUP BY 1)
    ORDER BY v NULLS LAST, id LIMIT 700""")(
    lambda m: FeatureQuery(m, ["OrderItem"]).sort_by(("quantity", "asc")).page(700).result().select("id"))
query("sort_multi_valued_desc", """SELECT id FROM (SELECT f.id, max(p.val_double) AS v FROM feature f
      LEFT JOIN property p ON p.feature_id = f.id AND p.name = 'quantity' WHERE objectclass_id = 21 GROUP BY 1)
    ORDER BY v DESC NULLS FIRST, id LIMIT 700""")(
    lambda m: FeatureQuery(m, ["OrderItem"]).sort_by(("quantity", "desc")).page(700).result().select("id"))
query("sort_two_keys", """SELECT f.id FROM feature f
    JOIN property p ON p.feature_id = f.id AND p.name = 'priority'
    JOIN property r ON r.feature_id = f.id AND r.name = 'price'
    ORDER BY p.val_string, r.val_double DESC, f.id LIMIT 100 OFFSET 50""")(
    lambda m: FeatureQuery(m, ["Order"]).sort_by(("priority", "asc"), ("price", "desc")).page(100, 50)
    .result().select("id"))
query("page_without_sort", "SELECT id FROM feature WHERE objectclass_id = 10 ORDER BY id LIMIT 40 OFFSET 25")(
    lambda m: FeatureQuery(m, ["Customer"]).page(40, 25).result().select("id"))
query("page_offset_only", "SELECT id FROM feature WHERE objectclass_id = 20 ORDER BY id OFFSET 1000")(
    lambda m: FeatureQuery(m, ["Order"]).page(None, 1000).result().select("id"))
query("page_deep", """SELECT f.id FROM feature f JOIN property r ON r.feature_id = f.id AND r.name = 'price'
    ORDER BY r.val_double DESC, f.id LIMIT 9000 OFFSET 4000""")(
    lambda m: FeatureQuery(m, ["Order"]).sort_by(("price", "desc")).page(9000, 4000).result().select("id"))
query("page_after", """SELECT f.id FROM feature f JOIN property r ON r.feature_id = f.id AND r.name = 'price'
    WHERE r.val_double < 250000 OR (r.val_double = 250000 AND f.id > 64) ORDER BY r.val_double DESC, f.id LIMIT 300""")(
    lambda m: FeatureQuery(m, ["Order"]).sort_by(("price", "desc")).after(250000.0, 64).page(300).result().select("id"))
query("sequenced_output", """SELECT id, row_number() OVER (ORDER BY val_double DESC NULLS FIRST, id) AS sequence_id
    FROM (SELECT f.id, p.val_double FROM feature f JOIN property p ON p.feature_id = f.id AND p.name = 'price')""")(
    lambda m: oq.sequenced(m.property.where("name = 'price'").select(F.col("feature_id").alias("id"), "val_double"),
                           [F.col("val_double").desc_nulls_first(), F.col("id")]).select("id", "sequence_id"))
query("union_all_tables", """SELECT id, 'feature' AS source FROM feature UNION ALL
    SELECT id, 'appearance' FROM appearance UNION ALL SELECT id, 'address' FROM address""")(
    lambda m: m.feature.select("id", F.lit("feature").alias("source"))
    .unionByName(m.appearance.select("id", F.lit("appearance").alias("source")))
    .unionByName(m.address.select("id", F.lit("address").alias("source"))))
query("distinct_multi_join", """SELECT DISTINCT e.feature_id AS id FROM property e JOIN property v
    ON v.feature_id = e.val_feature_id AND v.name = 'flag' WHERE e.name = 'item' AND v.val_string IN ('A', 'R')""")(
    lambda m: _q(m, ["Order"], lambda q: s.in_list(q.path("item", Step("flag", cast="string")), ["A", "R"]))
    .result().select("id"))
