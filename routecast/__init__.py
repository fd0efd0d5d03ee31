"""Evaluation analytics on PySpark: trial logs, judge panels, forecasts, splits and routing costs."""
