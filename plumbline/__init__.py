"""Plumbline: declarative query specifications as Spark DataFrames."""
