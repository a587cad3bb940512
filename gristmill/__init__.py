"""A text-quality engine for large collections of generated text, on Spark DataFrames."""
