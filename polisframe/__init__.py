"""Analytics on semantic 3D city models, written as Spark DataFrame operators."""

from polisframe.model import CityModel, TypeRegistry
from polisframe.operators.query import FeatureQuery, Step

__all__ = ["CityModel", "FeatureQuery", "Step", "TypeRegistry"]
