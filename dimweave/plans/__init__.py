"""Whole-job plans."""

from dimweave.plans.checks import BadAttributeValues, bad_values
from dimweave.plans.dimension import PLANS, REPORT_COLUMNS, attribute_values, demand_dimension, planned_business_days, write_attributes

__all__ = ["BadAttributeValues", "bad_values", "PLANS", "REPORT_COLUMNS", "demand_dimension", "planned_business_days", "attribute_values", "write_attributes"]
