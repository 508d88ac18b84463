"""Workload forecasting and capacity-scaling analytics on Spark DataFrames."""
