"""Logical plans: statement logs derived from tables, and the vocabulary as tables."""

from foldline.plans.logs import dealt, logged, point_selects, spread
from foldline.plans.words import keywords

__all__ = ["dealt", "keywords", "logged", "point_selects", "spread"]
