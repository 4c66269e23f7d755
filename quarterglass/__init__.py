"""quarterglass: entity x quarter panels on PySpark.

Every operator is a function from DataFrames to a DataFrame built from the
DataFrame API, so Catalyst sees one declarative plan from scan to report.
"""
