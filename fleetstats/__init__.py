"""Fleet telemetry analytics on Spark.

Every operator takes and returns DataFrames (or Columns) and names its columns by argument, so the
same code runs on landed fleet tables and on any other table of the same shape.
"""
