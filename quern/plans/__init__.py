"""Query language, query tree and its translation to DataFrames."""
