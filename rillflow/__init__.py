"""rillflow: declarative dataflow over Spark DataFrames."""
