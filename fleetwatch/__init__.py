"""Agent-fleet analytics as Spark table and stream operators.

Every operator takes DataFrames plus parameters and returns a lazy DataFrame; the
caller decides when to run it.
"""
