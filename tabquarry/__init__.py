"""tabquarry: profiling, data quality, statistics, imputation and feature preparation on Spark DataFrames."""
