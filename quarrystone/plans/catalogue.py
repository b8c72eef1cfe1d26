"""All queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from quarrystone.plans import arrays, curation, datasets, images, media, metrics, options, quality, samples, sequences, streams  # noqa: F401
from quarrystone.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
