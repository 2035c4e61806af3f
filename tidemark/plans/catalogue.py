"""All registered queries of the library's own operators, with their oracles."""

from __future__ import annotations

from tidemark.plans import forecast_queries, geodesy_queries, grid_queries, image_queries, scene_queries, series_queries, stream_queries, text_queries, warp_queries, window_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
