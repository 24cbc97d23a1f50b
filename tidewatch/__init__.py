"""Tidewatch: alert-stream analytics and training-data operators on PySpark DataFrames."""
