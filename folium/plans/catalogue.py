"""All queries of the package: importing the operator modules registers them."""

from __future__ import annotations

from folium.operators import citations, dictionary, documents, headings, index, keywords, layout, library, matching, records, retrieval, spans  # noqa: F401
from folium.plans.registry import QUERIES, SQL
from folium.streaming import status  # noqa: F401

FLAGSHIP = "u01_hybrid_fusion"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
