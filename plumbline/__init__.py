"""Run analytics and query operators over Spark DataFrames."""
