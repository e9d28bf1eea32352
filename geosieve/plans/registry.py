"""All registered queries with their SQL, by name."""

from geosieve.plans import aggregate, attribute, geometry, raster, spatial, stream  # noqa: F401
from geosieve.plans.registering import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
