"""Gaze and labelled time-series analytics on PySpark DataFrames."""
