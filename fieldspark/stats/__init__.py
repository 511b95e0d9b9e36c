"""Estimators: one aggregation pass over the rows in Spark, a small solve on the driver."""
