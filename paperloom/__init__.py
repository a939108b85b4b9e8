"""paperloom: document analytics expressed as Spark DataFrames."""
