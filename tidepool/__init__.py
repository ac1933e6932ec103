"""Market-panel analytics on PySpark DataFrames."""
