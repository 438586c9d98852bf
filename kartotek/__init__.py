"""Register analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames, so the work stays
partitioned and Catalyst sees the whole plan.
"""
