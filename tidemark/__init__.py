"""Point-in-time analytics as PySpark DataFrame operators.

Every operator takes and returns lazy DataFrames.  Histories only ever see
periods strictly before the row they describe.
"""
