"""Prompt plans and the query catalogue."""

from reelspan.plans import catalogue, cases, led, pieces, rendered  # noqa: F401  (all register queries)
