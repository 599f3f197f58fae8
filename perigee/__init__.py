"""A corpus novelty, authority and feed-ranking engine expressed on Spark DataFrames."""

__version__ = "0.1.0"
