"""viewgraph: multi-view image collections and large corpora as Spark DataFrames."""

__version__ = "0.1.0"
