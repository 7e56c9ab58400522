"""Named queries over the driver's tables."""

from __future__ import annotations

from strataflow.plans import extra, fields, models, more, physics, series, space, wells
from strataflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "extra", "fields", "models", "more", "physics", "series", "space", "wells"]
