"""Fleet analytics on Spark: DataFrame and Structured Streaming operators for HPC clusters.

Every operator takes DataFrames and column names and returns a DataFrame; nothing is
collected, and the physical strategy (broadcast or sort-merge, skew splitting, partition
counts) is left to Catalyst and adaptive execution.
"""

__version__ = "0.1.0"
