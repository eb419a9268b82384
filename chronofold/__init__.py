"""A tri-temporal effectivity and retrieval engine on PySpark DataFrames."""
