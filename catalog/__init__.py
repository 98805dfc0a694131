"""Checked queries, one per operator, registered by importing the modules."""

from catalog.base import ORACLES, QUERIES
from catalog import q_sources, q_grid, q_terrain, q_physics, q_imagery, q_labels, q_features, q_risk, q_feeds, q_plans

__all__ = ["ORACLES", "QUERIES"]
