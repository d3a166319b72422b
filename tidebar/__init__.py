"""tidebar: per-entity time-series analytics, backtesting and corpus preparation on Spark DataFrames."""
