"""Files: CityJSON and CityGML both ways, model directories, tiles, id lists, the change stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from polisframe.derive import city_model
from polisframe.model import ModelError
from polisframe.operators import changelog as cl
from polisframe.operators import loading as ld
from polisframe.operators import tiling as tl
from polisframe.operators.query import FeatureQuery, Step
from polisframe.sources import citygml, cityjson, tables
from polisframe.streaming import changelog as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    return city_model(spark, SF)


@pytest.fixture(scope="module")
def roots(m):
    return m.feature.where("objectclass_id = 20").orderBy("id").limit(30).select("id")


def test_cityjson_round_trip(spark, m, roots, tmp_path):
    path = str(tmp_path / "cj")
    cityjson.write_cityjson(m, roots, path, files=3)
    objects = cityjson.read_cityjson(spark, path + "/*/part*")
    from polisframe.operators.hierarchy import closure, contains_edges
    tree = closure(contains_edges(m), roots).select(F.col("node_id").alias("id")).join(m.feature, "id")
    assert objects.count() == tree.count() == objects.select("objectid").distinct().count()
    both = objects.join(tree.select("objectid", F.col("envelope").alias("e"), "objectclass_id"), "objectid")
    assert both.where("envelope.xmin <> e.xmin or envelope.xmax <> e.xmax or envelope.ymax <> e.ymax").count() == 0
    assert cityjson.with_classes(objects, m).join(
        tree.select("objectid", F.col("objectclass_id").alias("c")), "objectid").where("objectclass_id <> c").count() == 0
    out = ld.shred(cityjson.with_classes(objects, m), m)
    prices = out.property.where("name = 'price'").agg(F.sum("val_double")).first()[0]
    want = m.property.where("name = 'price'").join(roots.withColumnRenamed("id", "feature_id"), "feature_id").agg(
        F.sum("val_double")).first()[0]
    assert prices == pytest.approx(want)
    assert out.property.where("name = 'child'").count() == tree.count() - 30


def test_cityjson_keeps_all_values_and_the_tree(spark, m):
    import json
    from tests.test_operators import edges, make
    rows = [dict(id=10, feature_id=1, name="q", namespace_id=3, val_int=5), dict(id=11, feature_id=1, name="q", namespace_id=3, val_int=6),
            dict(id=12, feature_id=1, name="dims", namespace_id=3), dict(id=13, feature_id=1, parent_id=12, name="size", namespace_id=3, val_double=1.5),
            dict(id=14, feature_id=1, parent_id=12, name="deep", namespace_id=3), dict(id=15, feature_id=1, parent_id=14, name="x", namespace_id=3, val_string='a"b'),
            dict(id=16, feature_id=3, name="uri", namespace_id=3, val_uri="http://e.org")]
    tree = make(spark, m, [dict(id=i, objectclass_id=c, objectid=f"f{i}") for i, c in ((1, 20), (2, 21), (3, 21), (4, 22), (5, 20))],
                edges((1, 2), (1, 3), (2, 4), (3, 4), (5, 4)) + rows)
    lines = {r.root_id: json.loads(r.value) for r in cityjson.cityjson_lines(tree, tree.feature.where("id in (1, 5)").select("id"))[1].collect()}
    one = lines[1]["CityObjects"]
    assert one["f1"]["attributes"] == {"q": [5, 6], "dims": {"size": 1.5, "deep": {"x": 'a"b'}}} and one["f3"]["attributes"] == {"uri": "http://e.org"}
    assert one["f1"]["children"] == ["f2", "f3"] and one["f4"]["parents"] == ["f2", "f3"] and "parents" not in one["f1"]
    assert lines[5]["CityObjects"]["f4"]["parents"] == ["f5"] and set(lines[5]["CityObjects"]) == {"f4", "f5"}


def test_cityjson_templates_of_several_files(spark, m, tmp_path):
    """Equal templates of two files become one; a placement survives reading, shredding and writing."""
    square = {"type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2, 3]]]}
    line = {"type": "MultiLineString", "lod": "1", "boundaries": [[1, 0]]}
    corners = [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.5]]
    matrix = [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    for i, shapes in enumerate(([square, line], [square])):
        head = {"type": "CityJSON", "version": "2.0", "transform": {"scale": [0.5, 0.5, 0.5], "translate": [10, 0, 0]}, "CityObjects": {}, "vertices": [],
                "geometry-templates": {"templates": shapes, "vertices-templates": corners}}
        instances = [{"type": "GeometryInstance", "template": t, "boundaries": [0], "transformationMatrix": matrix} for t in range(len(shapes))]
        object_ = {"type": "OrderItem", "parents": ["none", "other"], "geometry": [*instances, {"type": "MultiPoint", "lod": "0", "boundaries": [0]}]}
        feature = {"type": "CityJSONFeature", "id": f"t{i}", "CityObjects": {f"t{i}": object_, f"plain{i}": {"type": "OrderItem"}}, "vertices": [[2, 4 + i, 6]]}
        (tmp_path / f"f{i}.jsonl").write_text("\n".join(map(json.dumps, (head, feature))))
    path = str(tmp_path / "*.jsonl")
    objects, templates = cityjson.read_cityjson(spark, path), cityjson.read_templates(spark, path)
    rows = {r.objectid: r for r in objects.collect()}
    assert [p.lod for p in rows["t0"].placements] == ["2", "1"] and rows["plain0"].placements is None and rows["t1"].parents == ["none", "other"]
    assert rows["t1"].placements[0].reference_point == [11.0, 2.5, 3.0] and len(rows["t0"].geometries) == 1
    assert templates.count() == 3 and templates.select("template_key").distinct().count() == 2
    out = ld.shred(cityjson.with_classes(objects, m), m, templates=templates)
    assert out.implicit_geometry.count() == 2 and out.property.where("val_implicitgeom_id is not null").count() == 3
    assert out.geometry_data.count() == 4 and out.geometry_data.where("feature_id is null").count() == 2
    head, lines = cityjson.cityjson_lines(out, out.feature.where("objectid like 't%'").select("id"))
    templates = json.loads(head.first().value)["geometry-templates"]
    assert [t["type"] for t in templates["templates"]].count("MultiSurface") == 1 and sorted(templates["vertices-templates"])[-1] == [1.0, 1.0, 0.0]
    written = {k: v for r in lines.collect() for k, v in json.loads(r.value)["CityObjects"].items()}
    kept = [g for g in written["t0"]["geometry"] if g["type"] == "GeometryInstance"]
    assert len(kept) == 2 and all(g["transformationMatrix"] == matrix for g in kept) and sorted(g["template"] for g in kept) == [0, 1]


GML = """<?xml version="1.0"?>
<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:gen="n">
<core:cityObjectMember><bldg:Building gml:id="B1"><gml:name>one</gml:name>
<gen:stringAttribute name="owner"><gen:value>me</gen:value></gen:stringAttribute>
<bldg:measuredHeight uom="m">12.5</bldg:measuredHeight>
<bldg:lod4Solid><gml:Solid><gml:exterior><gml:CompositeSurface>
<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList srsDimension="3">0 0 0 4 0 0 4 4 0 0 0 0</gml:posList>
</gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>1 1 0 2 1 0 2 2 0 1 1 0</gml:posList></gml:LinearRing>
</gml:interior></gml:Polygon></gml:surfaceMember>
<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 5 1 0 5 1 1 5 0 0 5</gml:posList>
</gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod4Solid>
<bldg:boundedBy><bldg:RoofSurface gml:id="R1"/></bldg:boundedBy><bldg:boundedBy><bldg:WallSurface gml:id="W1"/></bldg:boundedBy>
</bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="B2"/></core:cityObjectMember>
</core:CityModel>"""


def test_citygml(spark, m, tmp_path):
    (tmp_path / "a.gml").write_text(GML)
    rows = {r.objectid: r for r in citygml.read_citygml(spark, str(tmp_path / "a.gml"), lod4_as_lod3=True).withColumn(
        "a", F.to_json("attributes")).collect()}
    assert set(rows) == {"B1", "B2", "R1", "W1"}
    assert rows["R1"].parent_objectid == "B1" and rows["W1"].root_objectid == "B1" and rows["W1"].classname == "WallSurface"
    g = rows["B1"].geometries[0]
    assert g.lod == "3" and g.geometry_type == 9 and [len(p) for p in g.primitives] == [2, 1]
    assert rows["B1"].envelope.zmax == 5.0 and '"owner":"me"' in rows["B1"].a and '"measuredHeight":12.5' in rows["B1"].a


def test_citygml_keeps_text_units_and_inner_elements(spark, tmp_path):
    (tmp_path / "t.gml").write_text(GML.replace("12.5", "007").replace(">me<", "> m &amp; &lt;e&gt; <").replace("<gml:name>one</gml:name>", """<gml:name>one</gml:name>
      <bldg:function>a</bldg:function><bldg:function>2</bldg:function><core:externalReference><core:informationSystem>s</core:informationSystem>
      <core:externalObject><core:name>n1</core:name><core:name>n2</core:name></core:externalObject></core:externalReference>
      <core:genericAttribute><gen:DoubleAttribute><gen:name>load</gen:name><gen:value uom="kN">1.50</gen:value></gen:DoubleAttribute></core:genericAttribute>
      <bldg:lod1ImplicitRepresentation><core:ImplicitGeometry><core:transformationMatrix>1 0</core:transformationMatrix></core:ImplicitGeometry></bldg:lod1ImplicitRepresentation>"""))
    rows = {r.objectid: r for r in citygml.read_citygml(spark, str(tmp_path / "t.gml")).withColumn("a", F.to_json("attributes")).collect()}
    a = json.loads(rows["B1"].a)
    assert a == {"name": "one", "function": ["a", 2], "owner": "m & <e>", "measuredHeight": "007", "load": 1.5,
                 "externalReference": {"informationSystem": "s", "externalObject": {"name": ["n1", "n2"]}}}
    assert rows["B1"].units == {"measuredHeight": "m", "load": "kN"} and rows["B1"].unreadable == ["lod1ImplicitRepresentation"]
    assert rows["B2"].attributes is None and rows["B2"].geometries == []


def test_citygml_plans_grow_in_step_with_the_depth_of_attributes(spark, tmp_path):
    """Each level of attributes is read from what was written of it; a plan that held the levels below twice would double with every level."""
    def tables_read(depth):
        inner = "".join(f"<core:a{i}>" for i in range(depth)) + "7" + "".join(f"</core:a{i}>" for i in reversed(range(depth)))
        (tmp_path / f"d{depth}.gml").write_text(f'<core:CityModel><core:cityObjectMember><own:Order gml:id="o">{inner}</own:Order></core:cityObjectMember></core:CityModel>')
        rows = citygml.read_elements(spark, str(tmp_path / f"d{depth}.gml"), "core:cityObjectMember").where("not is_object and owner is not null")
        out = citygml._attributes(rows.withColumn("objectid", citygml._id_at(F.col("owner"))))
        (row,) = out.select(F.to_json("attributes").alias("a")).collect()
        assert row.a == "".join(f'{{"a{i}":' for i in range(depth)) + "7" + "}" * depth
        return out._jdf.queryExecution().analyzed().toString().count("Relation")

    few, many = tables_read(2), tables_read(6)
    assert many <= 3 * few


def test_citygml_round_trip(spark, m, roots, tmp_path):
    citygml.write_citygml(m, roots, str(tmp_path / "out"), files=3)
    back = citygml.read_citygml(spark, str(tmp_path / "out") + "/*/part*")
    from polisframe.operators.hierarchy import closure, contains_edges
    tree = closure(contains_edges(m), roots).select(F.col("node_id").alias("id")).join(m.feature, "id")
    assert back.count() == tree.count() == back.select("objectid").distinct().count()
    both = back.join(tree.select("objectid", F.col("envelope").alias("e"), F.col("id")), "objectid")
    assert both.where("envelope.xmin <> e.xmin or envelope.xmax <> e.xmax or envelope.ymax <> e.ymax").count() == 0
    shapes = both.select("id", F.explode("geometries").alias("g")).join(m.geometry_data.select(F.col("feature_id").alias("id"), F.col("primitives").alias("p"), "geometry_type"), "id")
    assert shapes.count() == tree.count() and shapes.where("g.primitives <> p or g.geometry_type <> geometry_type").count() == 0
    out = ld.shred(cityjson.with_classes(back, m), m)
    total = lambda x, ids: x.property.where("name = 'price'").join(ids, "feature_id").agg(F.sum("val_double")).first()[0]
    assert total(out, out.feature.select(F.col("id").alias("feature_id"))) == pytest.approx(total(m, roots.withColumnRenamed("id", "feature_id")))
    assert {r.val_uom for r in out.property.where("name = 'price'").collect()} == {"EUR"}
    from tests.test_operators import edges, make
    rows = [dict(id=10, feature_id=1, name="q", namespace_id=3, val_int=5), dict(id=11, feature_id=1, name="q", namespace_id=3, val_int=6),
            dict(id=12, feature_id=1, name="dims", namespace_id=3), dict(id=13, feature_id=1, parent_id=12, name="size", namespace_id=3, val_double=1.5),
            dict(id=15, feature_id=1, parent_id=12, name="x", namespace_id=3, val_string='a"b <&>'), dict(id=16, feature_id=1, name="code", namespace_id=3, val_string="007")]
    small = make(spark, m, [dict(id=i, objectclass_id=c, objectid=f"f{i}") for i, c in ((1, 20), (2, 21), (3, 21), (4, 22))], edges((1, 2), (1, 3), (2, 4), (3, 4)) + rows)
    citygml.write_citygml(small, small.feature.where("id = 1").select("id"), str(tmp_path / "small"), files=1)
    again = {r.objectid: r for r in citygml.read_citygml(spark, str(tmp_path / "small") + "/*/part*").withColumn("a", F.to_json("attributes")).collect()}
    assert json.loads(again["f1"].a) == {"q": [5, 6], "dims": {"size": 1.5, "x": 'a"b <&>'}, "code": "007"}
    assert {k: r.parent_objectid for k, r in again.items()} == {"f1": None, "f2": "f1", "f3": "f1", "f4": "f2"}


FORMS = """<?xml version="1.0"?>
<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:gen="n" xmlns:xlink="x">
<core:cityObjectMember><bldg:Building gml:id="X1">
 <gen:stringAttribute name="code"><gen:value>1234</gen:value></gen:stringAttribute>
 <gen:intAttribute name="n"><gen:value>7</gen:value></gen:intAttribute>
 <gen:measureAttribute name="h"><gen:value uom="m">2.5</gen:value></gen:measureAttribute>
 <bldg:lod2Solid><gml:Solid gml:id="s1"><gml:exterior_><gml:CompositeSurface>
   <gml:surfaceMember xlink:href="#w1p"/><gml:surfaceMember xlink:href="#w2p"/></gml:CompositeSurface></gml:exterior_></gml:Solid></bldg:lod2Solid>
 <bldg:lod1MultiSurface><gml:TriangulatedSurface><gml:trianglePatches>
   <gml:Triangle><gml:exterior><gml:LinearRing><gml:posList>0 0 0 1 0 0 0 1 0 0 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Triangle>
   <gml:Triangle><gml:exterior><gml:LinearRing><gml:posList>1 0 0 1 1 0 0 1 0 1 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Triangle>
   <gml:Triangle><gml:exterior><gml:LinearRing><gml:posList>5 0 0 6 1 0 5 1 0 5 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Triangle>
 </gml:trianglePatches></gml:TriangulatedSurface></bldg:lod1MultiSurface>
 <bldg:lod0FootPrint><gml:MultiSurface srsDimension="2"><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing>
   <gml:posList>0 0 4 0 4 4 0 4 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0FootPrint>
 <bldg:lod3Point><gml:Point srsDimension="2"><gml:pos>7 8</gml:pos></gml:Point></bldg:lod3Point>
 <bldg:lod3MultiSurface><gml:MultiSurface><gml:surfaceMember xlink:href="#nowhere"/></gml:MultiSurface></bldg:lod3MultiSurface>
 <bldg:boundedBy><bldg:WallSurface gml:id="W1"><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon gml:id="w1p">
   <gml:exterior><gml:LinearRing><gml:pos>0 0 0</gml:pos><gml:pos>1 0 0</gml:pos><gml:pos>1 0 3.5</gml:pos><gml:pos>0 0 0</gml:pos></gml:LinearRing></gml:exterior>
   <gml:interior><gml:LinearRing><gml:posList>.1 0 .1 .2 0 .1 .2 0 .2 .1 0 .1</gml:posList></gml:LinearRing></gml:interior>
   </gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:WallSurface></bldg:boundedBy>
 <bldg:boundedBy><bldg:WallSurface gml:id="W2"><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Surface><gml:patches><gml:PolygonPatch>
   <gml:exterior><gml:LinearRing><gml:posList>9 9 9 10 9 9 10 10 9 9 9 9</gml:posList></gml:LinearRing></gml:exterior></gml:PolygonPatch></gml:patches></gml:Surface></gml:surfaceMember>
   <gml:surfaceMember><gml:Polygon gml:id="w2p"><gml:exterior><gml:LinearRing><gml:posList>0 2 0 1 2 0 1 2 3 0 2 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>
   </gml:MultiSurface></bldg:lod2MultiSurface></bldg:WallSurface></bldg:boundedBy>
</bldg:Building></core:cityObjectMember>
</core:CityModel>
""".replace("exterior_", "exterior")


def test_citygml_forms_of_geometry(spark, tmp_path):
    (tmp_path / "f.gml").write_text(FORMS)
    rows = {r.objectid: r for r in citygml.read_citygml(spark, str(tmp_path / "f.gml")).withColumn("a", F.to_json("attributes")).collect()}
    assert set(rows) == {"X1", "W1", "W2"}
    x = {(g.lod, g.geometry_type): g for g in rows["X1"].geometries}
    assert [len(p) for p in x["1", 7].primitives] == [1, 1, 1] and x["1", 7].primitives[2][0][1] == [6.0, 1.0, 0.0]
    assert x["0", 8].primitives == [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]]
    assert x["3", 1].primitives == [[[[7.0, 8.0]]]]
    solid = x["2", 9]  # by reference
    assert [len(p) for p in solid.primitives] == [2, 1] and [n.object_id for n in solid.nodes] == [None, "w1p", "w2p"]
    assert rows["W1"].geometries[0].primitives[0][0][2] == [1.0, 0.0, 3.5] and rows["W1"].geometries[0].primitives[0][1][0] == [0.1, 0.0, 0.1]
    assert [len(p) for p in rows["W2"].geometries[0].primitives] == [1, 1]
    assert rows["X1"].unreadable == ["lod3MultiSurface"] and rows["W1"].unreadable == []
    assert '"code":"1234"' in rows["X1"].a and '"n":7' in rows["X1"].a and '"h":2.5' in rows["X1"].a


def test_standard_catalogue(spark, tmp_path):
    from polisframe.catalog import standard_catalogue
    (tmp_path / "a.gml").write_text(GML)
    known = standard_catalogue(spark)
    names = lambda ids: {known.types.classes[i]["classname"] for i in ids}
    assert names(known.types.feature_class_ids(["AbstractBuilding"])) == {"Building", "BuildingPart"}
    assert known.types.common_supertype(["RoofSurface", "WindowSurface"])["classname"] == "AbstractThematicSurface"
    out = ld.shred(cityjson.with_classes(citygml.read_citygml(spark, str(tmp_path / "a.gml")), known), known)
    found = FeatureQuery(out, ["Building"])
    from polisframe.functions import scalar as s
    from polisframe.operators.query import Step
    hit = found.where(s.compare(found.path(Step("measuredHeight", cast="double")), ">", 12)).result("objectid")
    assert [r.objectid for r in hit.collect()] == ["B1"]


def test_declared_properties_of_a_read_file(spark, tmp_path):
    """Values are kept by the declared type, types are inherited, parts are steps, and a number is compared as one."""
    from polisframe.catalog import standard_catalogue
    from polisframe.functions import scalar as s
    body = """<core:cityObjectMember><bldg:Building gml:id="B{i}"><con:dateOfConstruction>2001-05-06</con:dateOfConstruction>
      <con:height><con:Height><con:highReference>top</con:highReference><con:value uom="m">{h}</con:value></con:Height></con:height>
      <bldg:function>1000</bldg:function><bldg:function>007</bldg:function><bldg:storeysAboveGround>{i}</bldg:storeysAboveGround><bldg:own>{i}</bldg:own>
      <bldg:buildingPart><bldg:BuildingPart gml:id="P{i}"><bldg:storeysAboveGround>{h}</bldg:storeysAboveGround></bldg:BuildingPart></bldg:buildingPart>
      </bldg:Building></core:cityObjectMember>"""
    (tmp_path / "d.gml").write_text('<core:CityModel xmlns:core="c">' + "".join(body.format(i=i, h=h) for i, h in ((1, 9), (2, 20), (3, 100))) + "</core:CityModel>")
    known = standard_catalogue(spark)
    out = ld.shred(cityjson.with_classes(citygml.read_citygml(spark, str(tmp_path / "d.gml")), known), known)

    def hits(*path, op, value):
        q = FeatureQuery(out, ["AbstractBuilding"])
        return sorted(r.objectid for r in q.where(s.compare(q.path(*path), op, value)).result("objectid").collect())

    assert hits("height", "value", op=">", value=10) == ["B2", "B3"]  # as text 100 would be less than 20, and 9 more
    assert hits("storeysAboveGround", op="<", value=3) == ["B1", "B2"]
    assert hits("function", op="=", value="007") == ["B1", "B2", "B3"] and hits("function", op="=", value="1000") == ["B1", "B2", "B3"]
    q = FeatureQuery(out, ["Building"])
    assert [r.objectid for r in q.where(s.compare(q.path("buildingPart", "storeysAboveGround"), "=", 100)).result("objectid").collect()] == ["B3"]
    rows = {r.name: r for r in out.property.join(out.feature.where("objectid = 'B1'").select(F.col("id").alias("feature_id")), "feature_id").collect()}
    assert rows["dateOfConstruction"].val_timestamp.year == 2001 and rows["value"].val_uom == "m" and rows["value"].val_double == 9.0
    assert known.types.aliases[rows["storeysAboveGround"].namespace_id] == "bldg" and rows["own"].namespace_id == 3 and rows["own"].val_int == 1
    with pytest.raises(ModelError):
        q.path(Step("storeysAboveGround", cast="int"))


def test_model_directory_and_tiles(spark, m, tmp_path):
    tables.write_model(m, str(tmp_path / "v1"), ["feature", "property"])
    back = tables.read_model(spark, str(tmp_path / "v1"), ["feature", "property"])
    assert back.feature.count() == m.feature.count()
    assert back.property.where("name = 'item'").count() == m.property.where("name = 'item'").count()
    orders = FeatureQuery(m, ["Order"]).result("envelope")
    matrix = tl.dimension_scheme((0, 0, 1010, 1000), 250, 250)
    counts = tables.write_tiles(orders.withColumn("box", F.to_json("envelope")), matrix, str(tmp_path / "tiles"))
    written = spark.read.parquet(str(tmp_path / "tiles"))
    assert written.count() == counts.agg(F.sum("n")).first()[0]
    assert written.select("tile_col", "tile_row").distinct().count() == counts.select("tile_col", "tile_row").distinct().count()
    meta = tables.output_metadata(orders.where("false"), "t", tile=(0, 0, 1, 1)).first()
    assert meta.extent.xmax == 1.0


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.csv").write_text('# c\nName;GML_ID\nx;"a"\n\ny;b\n')
    got = ld.read_id_list(spark, str(tmp_path / "ids.csv"), "gml_id", delimiter=";", comment="#")
    assert sorted(r.id for r in got.collect()) == ["a", "b"]
    with pytest.raises(ModelError):
        ld.read_id_list(spark, str(tmp_path / "ids.csv"), "none", delimiter=";", comment="#")


def test_change_stream_equals_batch(spark, m, tmp_path):
    source = str(tmp_path / "log")
    log = m.feature_changelog
    log.where("id % 2 = 0").coalesce(1).write.parquet(source)
    log.where("id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    filters = dict(transaction_types=["update", "delete"], users=["u1", "u2"])
    found = stream.change_stream(spark, source, max_files=1, **filters)
    spark.conf.set("spark.sql.streaming.stopTimeout", "60s")
    q = found.writeStream.format("memory").queryName("tail").option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = cl.changes(m, **filters)
    assert spark.table("tail").count() == want.count() > 0
    counts = stream.windowed_counts(found, "1 day", "40 days")
    q = counts.writeStream.format("memory").outputMode("complete").queryName("days").option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == want.count()
