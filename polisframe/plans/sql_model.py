"""The derived city model (FIXTURES.md, section 3) once more, as SQL for the oracle.

Written separately from derive.py; envelopes are flat columns here.
"""

from __future__ import annotations

import re

_ORDER, _CUST, _SUPP, _PART = "{} * 64", "{} * 64 + 60", "{} * 64 + 61", "{} * 64 + 62"
_FLAG = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
_ITEM = "(l_orderkey * 64 + 1 + l_linenumber)"
_DETAIL = f"(l_orderkey * 64 + 16 + l_linenumber * 4 + {_FLAG})"


def _box(k: str, shift: str = "0", sx: int = 1009, sy: int = 997, block: int = 200000, flat: str | None = None,
         when: str = "true") -> str:
    xmin = f"((({k} % {sx}) * ({k} % {sx}) * 31 + ({k} % {sx}) * 7919) % {sx} + ({k} // {block}) * {sx} + {shift})"
    ymin = f"((({k} % {sy}) * ({k} % {sy}) * 17 + ({k} % {sy}) * 104729) % {sy})"
    two_d = flat or f"{k} % 4 = 0"
    part = lambda cond, expr, name: f"CASE WHEN {cond} THEN CAST({expr} AS DOUBLE) END AS {name}"
    return ", ".join([
        part(when, xmin, "xmin"), part(when, ymin, "ymin"), part(f"({when}) AND NOT ({two_d})", "0", "zmin"),
        part(when, f"{xmin} + 1 + {k} % 5", "xmax"), part(when, f"{ymin} + 1 + {k} % 3", "ymax"),
        part(f"({when}) AND NOT ({two_d})", f"3 + {k} % 10", "zmax")])


_DATES = """o_orderdate AS creation_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS termination_date,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS valid_from,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS valid_to"""


def _other_dates(key: str) -> str:
    return (f"CAST(DATE '1994-01-01' + CAST({key} % 365 AS INTEGER) AS TIMESTAMP) AS creation_date, "
            "CAST(NULL AS TIMESTAMP) AS termination_date, CAST(NULL AS TIMESTAMP) AS valid_from, "
            "CAST(NULL AS TIMESTAMP) AS valid_to")


_FEATURE = f"""
SELECT o_orderkey * 64 AS id, 20 AS objectclass_id, 'O_' || o_orderkey AS objectid, {_box('o_orderkey')}, {_DATES}
FROM orders
UNION ALL
SELECT {_ITEM}, 21, 'I_' || l_orderkey || '_' || l_linenumber, {_box('l_orderkey', 'l_linenumber')}, {_DATES}
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
UNION ALL
SELECT {_DETAIL}, 22, 'D_' || l_orderkey || '_' || l_linenumber || '_' || l_returnflag,
  {_box('l_orderkey', 'l_linenumber')}, {_DATES}
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
UNION ALL
SELECT c_custkey * 64 + 60, 10, 'C_' || c_custkey, {_box('c_custkey', when='c_custkey % 10 <> 0')},
  {_other_dates('c_custkey')} FROM customer
UNION ALL
SELECT s_suppkey * 64 + 61, 11, 'S_' || s_suppkey, {_box('s_suppkey')}, {_other_dates('s_suppkey')} FROM supplier
UNION ALL
SELECT p_partkey * 64 + 62, 30, 'P_' || p_partkey, {_box('p_partkey', when='false')}, {_other_dates('p_partkey')}
FROM part"""

_VALUES = {"parent_id": "BIGINT", "val_int": "BIGINT", "val_double": "DOUBLE", "val_string": "VARCHAR",
           "val_uom": "VARCHAR", "val_array": "VARCHAR", "val_lod": "VARCHAR", "val_geometry_id": "BIGINT",
           "val_implicitgeom_id": "BIGINT", "val_address_id": "BIGINT", "val_feature_id": "BIGINT",
           "val_relation_type": "INTEGER", "ref_x": "DOUBLE", "ref_y": "DOUBLE"}


def _prop(source: str, fid: str, code: str, name: str, dtype: int, ns: int = 2, id_: str | None = None,
          **values: str) -> str:
    cols = ", ".join(f"CAST({values.get(n, 'NULL')} AS {t}) AS {n}" for n, t in _VALUES.items())
    return (f"SELECT {id_ or f'({fid}) * 1000 + {code}'} AS id, {fid} AS feature_id, {dtype} AS datatype_id, "
            f"{ns} AS namespace_id, '{name}' AS name, {cols} FROM {source}")


_ITEMS = "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"
_DETAILS = "(SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)"
_FIRST = ("(SELECT l_orderkey, l_linenumber, min(l_suppkey) AS suppkey, min(l_partkey) AS partkey FROM lineitem "
          "GROUP BY 1, 2)")
_O, _C, _S, _P = "o_orderkey * 64", "c_custkey * 64 + 60", "s_suppkey * 64 + 61", "p_partkey * 64 + 62"

_PROPERTY = "\nUNION ALL\n".join([
    _prop("orders", _O, "2", "priority", 7, val_string="o_orderpriority"),
    _prop("orders", _O, "3", "price", 8, val_double="o_totalprice", val_uom="'EUR'"),
    _prop("customer", _C, "2", "segment", 7, val_string="c_mktsegment"),
    _prop("customer", _C, "3", "balance", 3, val_double="c_acctbal"),
    _prop("customer", _C, "4", "nation", 2, val_int="c_nationkey"),
    _prop("customer", _C, "5", "address", 12, ns=1, val_address_id="c_custkey // 2"),
    _prop("supplier", _S, "3", "balance", 3, val_double="s_acctbal"),
    _prop("supplier", _S, "4", "nation", 2, val_int="s_nationkey"),
    _prop("(SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem)", _ITEM,
          "100 + CAST(l_quantity AS BIGINT)", "quantity", 3, val_double="l_quantity"),
    _prop(_DETAILS, _ITEM, f"200 + {_FLAG}", "flag", 4, ns=3, val_string="l_returnflag"),
    _prop("part", _P, "2", "dims", 20),
    _prop("part", _P, "3", "size", 2, parent_id=f"({_P}) * 1000 + 2", val_int="p_size"),
    _prop("part", _P, "4", "type", 4, parent_id=f"({_P}) * 1000 + 2", val_string="p_type"),
    _prop(_ITEMS, "l_orderkey * 64", "100 + l_linenumber", "item", 9, val_feature_id=_ITEM, val_relation_type="1"),
    _prop(_DETAILS, _ITEM, f"300 + {_FLAG}", "boundary", 9, ns=1, val_feature_id=_DETAIL, val_relation_type="1"),
    _prop("orders", "o_custkey * 64 + 60", "", "order", 9, id_="o_orderkey * 64 * 1000 + 900", val_feature_id=_O,
          val_relation_type="0"),
    _prop(_FIRST, _ITEM, "5", "supplier", 9, val_feature_id="suppkey * 64 + 61", val_relation_type="0"),
    _prop(_FIRST, _ITEM, "6", "shape", 11, val_lod="(l_orderkey + l_linenumber) % 4",
          val_implicitgeom_id="partkey % 50 + 1",
          val_array="'[2,0,0,' || (partkey % 7) || ',0,2,0,' || (partkey % 5) || ',0,0,1,0,0,0,0,1]'",
          ref_x="l_orderkey", ref_y="l_linenumber"),
    _prop("orders", _O, "1", "geometry", 10, val_lod="o_orderkey % 4", val_geometry_id=_O),
    _prop(_ITEMS, _ITEM, "1", "geometry", 10, val_lod="(l_orderkey + 1) % 4", val_geometry_id=_ITEM),
    _prop(_DETAILS, _DETAIL, "1", "geometry", 10, val_lod="(l_orderkey + 2) % 4", val_geometry_id=_DETAIL),
])

_KINDS = ("CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'update' WHEN 'click' THEN 'update' "
          "WHEN 'error' THEN 'terminate' WHEN 'purchase' THEN 'delete' END")
_SURFACE = ("'G_' || (c_custkey * 64) || CASE WHEN c_custkey % 5 = 0 THEN '_gone' WHEN c_custkey % 3 = 0 THEN '' "
            "ELSE '_s0' END")

TABLES = {
    "objectclass": """SELECT * FROM (VALUES
 (1, NULL, 'AbstractObject', 1, 0), (2, 1, 'AbstractParty', 1, 0), (3, 1, 'AbstractTransaction', 1, 0),
 (10, 2, 'Customer', 0, 1), (11, 2, 'Supplier', 0, 1), (20, 3, 'Order', 0, 1), (21, 3, 'OrderItem', 0, 0),
 (22, 3, 'ItemDetail', 0, 0), (30, 1, 'Part', 0, 1), (40, 1, 'AbstractSurfaceData', 1, 0),
 (41, 40, 'X3DMaterial', 0, 0), (42, 40, 'ParameterizedTexture', 0, 0), (43, 40, 'GeoreferencedTexture', 0, 0),
 (50, 1, 'Address', 0, 0)) AS v(id, superclass_id, classname, is_abstract, is_toplevel)""",
    "feature": _FEATURE,
    "property": _PROPERTY,
    "geometry_data": """SELECT id, id AS feature_id, CASE (id // 64) % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 9 END
 AS geometry_type, xmin, ymin, zmin, xmax, ymax, zmax FROM feature WHERE xmin IS NOT NULL""",
    "implicit_geometry": """SELECT DISTINCT p_partkey % 50 + 1 AS id, 'T_' || (p_partkey % 50 + 1) AS objectid,
 CASE WHEN (p_partkey % 50 + 1) % 10 = 0 THEN 'library.glb' END AS reference_to_library,
 CASE WHEN (p_partkey % 50 + 1) % 10 <> 0 THEN (p_partkey % 50 + 1) * 64 END AS relative_geometry_id FROM part""",
    "address": """SELECT c_custkey // 2 AS id, 'A_' || (c_custkey // 2) AS objectid,
 'Street ' || ((c_custkey // 2) % 97) AS street, 'City ' || min(c_nationkey) AS city FROM customer GROUP BY 1, 2, 3""",
    "appearance": """SELECT c_custkey AS id, 'AP_' || c_custkey AS objectid,
 CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS theme,
 CASE WHEN c_custkey % 50 <> 0 THEN c_custkey * 64 + 60 END AS feature_id, CAST(NULL AS BIGINT) AS implicit_geometry_id
 FROM customer""",
    "surface_data": """SELECT c_custkey AS id, 'SD_' || c_custkey AS objectid,
 CAST(c_custkey % 3 + 41 AS INTEGER) AS objectclass_id,
 CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 20 END AS tex_image_id FROM customer""",
    "tex_image": "SELECT DISTINCT c_custkey % 20 AS id, 'tex_' || (c_custkey % 20) || '.png' AS image_uri FROM customer",
    "appear_to_surface_data": "SELECT c_custkey AS id, c_custkey AS appearance_id, c_custkey AS surface_data_id "
                              "FROM customer",
    "surface_data_mapping": f"""SELECT c_custkey AS surface_data_id, c_custkey * 64 AS geometry_data_id,
 {_SURFACE} AS surface_object_id, c_custkey % 3 = 0 AS material, c_custkey % 3 = 1 AS texture,
 c_custkey % 3 = 2 AS georeferenced, CASE WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END END
 AS texture_rings FROM customer""",
    "codelist": """SELECT r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'class' ELSE 'function' END
 AS codelist_type, 'http://example.org/codes/' || lower(r_name) AS url FROM region""",
    "feature_changelog": f"""SELECT event_id AS id, user_id * 64 + 60 AS feature_id, 10 AS objectclass_id,
 'C_' || user_id AS objectid, {_KINDS} AS transaction_type, ts AS transaction_date, 'u' || (user_id % 5) AS db_user,
 CASE WHEN value >= 5 THEN 'r' || (event_id % 3) END AS reason_for_update,
 {_box('event_id', sx=2003, sy=1999, block=100000, flat='true', when='event_id % 11 <> 0')} FROM events""",
}
_NEEDS = {"geometry_data": ["feature"]}


def with_tables(sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the CTEs of the tables it names; a WITH of its own is merged."""
    used = []
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            used += [n for n in [*_NEEDS.get(name, []), name] if n not in used]
    # a table that is named several times is computed once
    often = {n for n in used if len(re.findall(rf"\b{n}\b", sql)) > 1}
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in often else ''}({TABLES[n]})" for n in sorted(used, key=list(TABLES).index))
    body = sql.strip()
    own = body[:5].upper() == "WITH "
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not ctes:
        return (head + body[5:]) if own else body
    return f"{head}{ctes},\n{body[5:]}" if own else f"{head}{ctes}\n{body}"
