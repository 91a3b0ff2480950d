"""Set-oriented analytics over data-pipeline metadata, built on Spark DataFrames."""
