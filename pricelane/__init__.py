"""Retail price-optimisation analytics as Spark DataFrame operators."""

from pricelane.config import PricingConfig

__all__ = ["PricingConfig"]
