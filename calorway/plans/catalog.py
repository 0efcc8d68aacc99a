"""All registered queries."""

from . import (  # noqa: F401
    build_queries, derived_city, graph_queries, map_queries, response_queries, route_queries, search_queries, shade_queries, thermal_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
