"""The catalogue of a standard city model: namespaces, data types and feature types, as metadata tables."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from polisframe.model import SCHEMAS, CityModel
from polisframe.runtime import local_frame

# Namespace aliases by id (1 and 3 are the ids the LoD search and generic attributes rely on).
NAMESPACES = {1: "core", 2: "app", 3: "gen", 4: "bldg", 5: "brid", 6: "con", 7: "dem", 8: "frn", 9: "grp", 10: "luse",
              11: "pcl", 12: "tran", 13: "tun", 14: "veg", 15: "vers", 16: "wtr", 17: "dyn"}

# Data types as (namespace, name).
DATA_TYPES = (
    ("core", "Boolean"),
    ("core", "Integer"),
    ("core", "Double"),
    ("core", "String"),
    ("core", "URI"),
    ("core", "Timestamp"),
    ("core", "Code"),
    ("core", "Measure"),
    ("core", "FeatureProperty"),
    ("core", "GeometryProperty"),
    ("core", "ImplicitGeometryProperty"),
    ("core", "AddressProperty"),
    ("core", "AppearanceProperty"),
    ("core", "Reference"),
    ("core", "CityObjectRelation"),
    ("core", "Duration"),
    ("core", "ExternalReference"),
    ("core", "MeasureOrNilReasonList"),
    ("core", "Occupancy"),
    ("core", "QualifiedArea"),
    ("core", "QualifiedVolume"),
    ("core", "StringOrRef"),
    ("core", "TimePosition"),
    ("con", "ConstructionEvent"),
    ("con", "Elevation"),
    ("con", "Height"),
    ("bldg", "RoomHeight"),
    ("gen", "GenericAttributeSet"),
    ("grp", "Role"),
    ("dyn", "AttributeReference"),
    ("dyn", "SensorConnection"),
    ("dyn", "TimeseriesComponent"),
    ("dyn", "TimeAppearance"),
    ("dyn", "TimeBoolean"),
    ("dyn", "TimeDouble"),
    ("dyn", "TimeGeometry"),
    ("dyn", "TimeImplicitGeometry"),
    ("dyn", "TimeInteger"),
    ("dyn", "TimeString"),
    ("dyn", "TimeURI"),
    ("vers", "Transaction"),
)

# Feature types as (namespace, name, superclass, top level).
FEATURE_TYPES = (
    ("core", "AbstractFeature", None, False),
    ("core", "AbstractFeatureWithLifespan", "AbstractFeature", False),
    ("core", "AbstractCityObject", "AbstractFeatureWithLifespan", False),
    ("core", "AbstractSpace", "AbstractCityObject", False),
    ("core", "AbstractLogicalSpace", "AbstractSpace", False),
    ("core", "AbstractPhysicalSpace", "AbstractSpace", False),
    ("core", "AbstractOccupiedSpace", "AbstractPhysicalSpace", False),
    ("core", "AbstractUnoccupiedSpace", "AbstractPhysicalSpace", False),
    ("core", "AbstractSpaceBoundary", "AbstractCityObject", False),
    ("core", "AbstractThematicSurface", "AbstractSpaceBoundary", False),
    ("core", "AbstractDynamizer", "AbstractFeature", False),
    ("core", "AbstractPointCloud", "AbstractFeature", False),
    ("core", "Address", "AbstractFeature", False),
    ("core", "CityModel", "AbstractFeatureWithLifespan", False),
    ("core", "ClosureSurface", "AbstractThematicSurface", False),
    ("con", "AbstractConstruction", "AbstractOccupiedSpace", False),
    ("con", "AbstractConstructionSurface", "AbstractThematicSurface", False),
    ("con", "AbstractConstructiveElement", "AbstractOccupiedSpace", False),
    ("con", "AbstractFillingElement", "AbstractOccupiedSpace", False),
    ("con", "AbstractFillingSurface", "AbstractThematicSurface", False),
    ("con", "AbstractFurniture", "AbstractOccupiedSpace", False),
    ("con", "AbstractInstallation", "AbstractOccupiedSpace", False),
    ("con", "CeilingSurface", "AbstractConstructionSurface", False),
    ("con", "Door", "AbstractFillingElement", False),
    ("con", "DoorSurface", "AbstractFillingSurface", False),
    ("con", "FloorSurface", "AbstractConstructionSurface", False),
    ("con", "GroundSurface", "AbstractConstructionSurface", False),
    ("con", "InteriorWallSurface", "AbstractConstructionSurface", False),
    ("con", "OtherConstruction", "AbstractConstruction", True),
    ("con", "OuterCeilingSurface", "AbstractConstructionSurface", False),
    ("con", "OuterFloorSurface", "AbstractConstructionSurface", False),
    ("con", "RoofSurface", "AbstractConstructionSurface", False),
    ("con", "WallSurface", "AbstractConstructionSurface", False),
    ("con", "Window", "AbstractFillingElement", False),
    ("con", "WindowSurface", "AbstractFillingSurface", False),
    ("bldg", "AbstractBuilding", "AbstractConstruction", False),
    ("bldg", "AbstractBuildingSubdivision", "AbstractLogicalSpace", False),
    ("bldg", "Building", "AbstractBuilding", True),
    ("bldg", "BuildingPart", "AbstractBuilding", False),
    ("bldg", "BuildingConstructiveElement", "AbstractConstructiveElement", False),
    ("bldg", "BuildingFurniture", "AbstractFurniture", False),
    ("bldg", "BuildingInstallation", "AbstractInstallation", False),
    ("bldg", "BuildingRoom", "AbstractUnoccupiedSpace", False),
    ("bldg", "BuildingUnit", "AbstractBuildingSubdivision", False),
    ("bldg", "Storey", "AbstractBuildingSubdivision", False),
    ("brid", "AbstractBridge", "AbstractConstruction", False),
    ("brid", "Bridge", "AbstractBridge", True),
    ("brid", "BridgePart", "AbstractBridge", False),
    ("brid", "BridgeConstructiveElement", "AbstractConstructiveElement", False),
    ("brid", "BridgeFurniture", "AbstractFurniture", False),
    ("brid", "BridgeInstallation", "AbstractInstallation", False),
    ("brid", "BridgeRoom", "AbstractUnoccupiedSpace", False),
    ("tun", "AbstractTunnel", "AbstractConstruction", False),
    ("tun", "Tunnel", "AbstractTunnel", True),
    ("tun", "TunnelPart", "AbstractTunnel", False),
    ("tun", "TunnelConstructiveElement", "AbstractConstructiveElement", False),
    ("tun", "TunnelFurniture", "AbstractFurniture", False),
    ("tun", "TunnelInstallation", "AbstractInstallation", False),
    ("tun", "HollowSpace", "AbstractUnoccupiedSpace", False),
    ("tran", "AbstractTransportationSpace", "AbstractUnoccupiedSpace", False),
    ("tran", "Road", "AbstractTransportationSpace", True),
    ("tran", "Railway", "AbstractTransportationSpace", True),
    ("tran", "Track", "AbstractTransportationSpace", True),
    ("tran", "Square", "AbstractTransportationSpace", True),
    ("tran", "Waterway", "AbstractTransportationSpace", True),
    ("tran", "Section", "AbstractTransportationSpace", False),
    ("tran", "Intersection", "AbstractTransportationSpace", False),
    ("tran", "TrafficSpace", "AbstractUnoccupiedSpace", False),
    ("tran", "AuxiliaryTrafficSpace", "AbstractUnoccupiedSpace", False),
    ("tran", "ClearanceSpace", "AbstractUnoccupiedSpace", False),
    ("tran", "Hole", "AbstractUnoccupiedSpace", False),
    ("tran", "TrafficArea", "AbstractThematicSurface", False),
    ("tran", "AuxiliaryTrafficArea", "AbstractThematicSurface", False),
    ("tran", "Marking", "AbstractThematicSurface", False),
    ("tran", "HoleSurface", "AbstractThematicSurface", False),
    ("dem", "ReliefFeature", "AbstractSpaceBoundary", True),
    ("dem", "AbstractReliefComponent", "AbstractSpaceBoundary", False),
    ("dem", "BreaklineRelief", "AbstractReliefComponent", False),
    ("dem", "MassPointRelief", "AbstractReliefComponent", False),
    ("dem", "RasterRelief", "AbstractReliefComponent", False),
    ("dem", "TINRelief", "AbstractReliefComponent", False),
    ("frn", "CityFurniture", "AbstractOccupiedSpace", True),
    ("grp", "CityObjectGroup", "AbstractLogicalSpace", True),
    ("luse", "LandUse", "AbstractThematicSurface", True),
    ("pcl", "PointCloud", "AbstractPointCloud", False),
    ("veg", "AbstractVegetationObject", "AbstractOccupiedSpace", False),
    ("veg", "PlantCover", "AbstractVegetationObject", True),
    ("veg", "SolitaryVegetationObject", "AbstractVegetationObject", True),
    ("wtr", "WaterBody", "AbstractOccupiedSpace", True),
    ("wtr", "AbstractWaterBoundarySurface", "AbstractThematicSurface", False),
    ("wtr", "WaterGroundSurface", "AbstractWaterBoundarySurface", False),
    ("wtr", "WaterSurface", "AbstractWaterBoundarySurface", False),
    ("gen", "GenericLogicalSpace", "AbstractLogicalSpace", True),
    ("gen", "GenericOccupiedSpace", "AbstractOccupiedSpace", True),
    ("gen", "GenericUnoccupiedSpace", "AbstractUnoccupiedSpace", True),
    ("gen", "GenericThematicSurface", "AbstractThematicSurface", False),
    ("vers", "Version", "AbstractFeatureWithLifespan", False),
    ("vers", "VersionTransition", "AbstractFeatureWithLifespan", False),
    ("dyn", "Dynamizer", "AbstractDynamizer", False),
    ("dyn", "AbstractTimeseries", "AbstractFeature", False),
    ("dyn", "CompositeTimeseries", "AbstractTimeseries", False),
    ("dyn", "GenericTimeseries", "AbstractTimeseries", False),
    ("dyn", "StandardFileTimeseries", "AbstractTimeseries", False),
    ("dyn", "TabulatedFileTimeseries", "AbstractTimeseries", False),
)


# Declared properties as (feature type, name, namespace, type, target feature type); subtypes inherit them.
PROPERTIES = (
    ("AbstractFeature", "description", "core", "String", None),
    ("AbstractFeature", "name", "core", "Code", None),
    ("AbstractCityObject", "relativeToTerrain", "core", "String", None),
    ("AbstractCityObject", "relativeToWater", "core", "String", None),
    ("AbstractCityObject", "generalizesTo", "core", "FeatureProperty", "AbstractCityObject"),
    ("AbstractCityObject", "externalReference", "core", "ExternalReference", None),
    ("AbstractSpace", "spaceType", "core", "String", None),
    ("AbstractSpace", "volume", "core", "QualifiedVolume", None),
    ("AbstractSpace", "area", "core", "QualifiedArea", None),
    ("AbstractSpace", "boundary", "core", "FeatureProperty", "AbstractSpaceBoundary"),
    ("AbstractThematicSurface", "area", "core", "QualifiedArea", None),
    ("AbstractConstruction", "conditionOfConstruction", "con", "String", None),
    ("AbstractConstruction", "dateOfConstruction", "con", "Timestamp", None),
    ("AbstractConstruction", "dateOfDemolition", "con", "Timestamp", None),
    ("AbstractConstruction", "constructionEvent", "con", "ConstructionEvent", None),
    ("AbstractConstruction", "elevation", "con", "Elevation", None),
    ("AbstractConstruction", "height", "con", "Height", None),
    ("AbstractConstructionSurface", "fillingSurface", "con", "FeatureProperty", "AbstractFillingSurface"),
    ("AbstractBuilding", "class", "bldg", "Code", None),
    ("AbstractBuilding", "function", "bldg", "Code", None),
    ("AbstractBuilding", "usage", "bldg", "Code", None),
    ("AbstractBuilding", "roofType", "bldg", "Code", None),
    ("AbstractBuilding", "storeysAboveGround", "bldg", "Integer", None),
    ("AbstractBuilding", "storeysBelowGround", "bldg", "Integer", None),
    ("AbstractBuilding", "buildingConstructiveElement", "bldg", "FeatureProperty", "BuildingConstructiveElement"),
    ("AbstractBuilding", "buildingInstallation", "bldg", "FeatureProperty", "BuildingInstallation"),
    ("AbstractBuilding", "buildingRoom", "bldg", "FeatureProperty", "BuildingRoom"),
    ("AbstractBuilding", "buildingSubdivision", "bldg", "FeatureProperty", "AbstractBuildingSubdivision"),
    ("AbstractBuilding", "address", "bldg", "AddressProperty", None),
    ("Building", "buildingPart", "bldg", "FeatureProperty", "BuildingPart"),
    ("BuildingRoom", "roomHeight", "bldg", "RoomHeight", None),
    ("Storey", "sortKey", "bldg", "Double", None),
    ("AbstractBridge", "isMovable", "brid", "Boolean", None),
    ("Bridge", "bridgePart", "brid", "FeatureProperty", "BridgePart"),
    ("Tunnel", "tunnelPart", "tun", "FeatureProperty", "TunnelPart"),
    ("AbstractTransportationSpace", "trafficSpace", "tran", "FeatureProperty", "TrafficSpace"),
    ("AbstractTransportationSpace", "auxiliaryTrafficSpace", "tran", "FeatureProperty", "AuxiliaryTrafficSpace"),
    ("TrafficArea", "surfaceMaterial", "tran", "Code", None),
    ("Road", "section", "tran", "FeatureProperty", "Section"),
    ("Road", "intersection", "tran", "FeatureProperty", "Intersection"),
    ("SolitaryVegetationObject", "species", "veg", "Code", None),
    ("SolitaryVegetationObject", "height", "veg", "Measure", None),
    ("SolitaryVegetationObject", "trunkDiameter", "veg", "Measure", None),
    ("SolitaryVegetationObject", "crownDiameter", "veg", "Measure", None),
    ("PlantCover", "averageHeight", "veg", "Measure", None),
    ("ReliefFeature", "lod", "dem", "Integer", None),
    ("ReliefFeature", "reliefComponent", "dem", "FeatureProperty", "AbstractReliefComponent"),
    ("CityObjectGroup", "groupMember", "grp", "FeatureProperty", "AbstractCityObject"),
)

# Declared properties of data types as (data type, name, namespace, type).
TYPE_PROPERTIES = (
    ("Height", "highReference", "con", "Code"),
    ("Height", "lowReference", "con", "Code"),
    ("Height", "status", "con", "String"),
    ("Height", "value", "con", "Measure"),
    ("RoomHeight", "highReference", "bldg", "Code"),
    ("RoomHeight", "lowReference", "bldg", "Code"),
    ("RoomHeight", "status", "bldg", "String"),
    ("RoomHeight", "value", "bldg", "Measure"),
    ("Elevation", "elevationReference", "con", "Code"),
    ("ConstructionEvent", "event", "con", "Code"),
    ("ConstructionEvent", "dateOfEvent", "con", "Timestamp"),
    ("ConstructionEvent", "description", "con", "String"),
    ("QualifiedArea", "area", "core", "Measure"),
    ("QualifiedArea", "typeOfArea", "core", "Code"),
    ("QualifiedVolume", "volume", "core", "Measure"),
    ("QualifiedVolume", "typeOfVolume", "core", "Code"),
    ("ExternalReference", "targetResource", "core", "URI"),
    ("ExternalReference", "informationSystem", "core", "URI"),
    ("ExternalReference", "relationType", "core", "URI"),
)


def _schema(rows: list[tuple]) -> str | None:
    """The schema document of a type that declares these (name, namespace, type, target)."""
    keys = ("name", "namespace", "type", "target")
    return json.dumps({"properties": [dict(zip(keys, r, strict=False)) for r in rows]}) if rows else None


def standard_catalogue(spark: SparkSession) -> CityModel:
    """A model without features that knows the standard types; load city objects into it with ``shred``."""
    ids = {alias: i for i, alias in NAMESPACES.items()}
    number = {name: i for i, (_, name, _, _) in enumerate(FEATURE_TYPES, 1)}
    return CityModel(spark, {
        "namespace": local_frame(spark, [(i, a, None, None) for i, a in NAMESPACES.items()], SCHEMAS["namespace"]),
        "datatype": local_frame(spark, [
            (i, None, n, 0, ids[a], _schema([p[1:] for p in TYPE_PROPERTIES if p[0] == n])) for i, (a, n) in enumerate(DATA_TYPES, 1)],
                                SCHEMAS["datatype"]),
        "objectclass": local_frame(spark, [
            (number[n], number.get(p), n, int(n.startswith("Abstract")), int(top), ids[a],
             "address" if n == "Address" else "feature", _schema([q[1:] for q in PROPERTIES if q[0] == n])) for a, n, p, top in FEATURE_TYPES], SCHEMAS["objectclass"]),
    })
