"""flowsight: network-security flow analytics expressed as Spark DataFrame work.

Layout
------
schema      canonical flow columns, alias maps, schema checks
functions   column functions (formulas, rules, parsing)
sources     readers and writers
operators   DataFrame -> DataFrame building blocks
models      distributed classifiers and outlier detectors
streaming   Structured Streaming jobs
plans       whole jobs composed from the above
catalog     the registered queries and their SQL twins
"""
