"""All reference queries and their SQL."""

from __future__ import annotations

from .plans import formats, geometry, metadata, surfaces, tracks  # noqa: F401
from .plans.common import ORACLE_SQL, QUERIES  # noqa: F401
