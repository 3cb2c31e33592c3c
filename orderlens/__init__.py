"""Demand analytics on order lines, expressed as Spark DataFrame plans."""
