"""Selective-label analytics as Spark DataFrame jobs.

The outcome of a unit is known only where a decision was taken.  Every public
operator takes DataFrames and column names and returns a DataFrame; nothing
unit-level ever reaches the driver.
"""
