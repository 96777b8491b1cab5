"""tidemark: membership-leakage and distribution-shift analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame. Work is expressed with
built-in Spark SQL functions, joins, aggregations and windows; Python only runs
inside Arrow-batched pandas functions where no native expression exists.
"""

__version__ = "0.1.0"
