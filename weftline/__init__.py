"""Source-text analytics on Spark: scan, extract, attach, join, merge, render, compare, score and search."""
