"""DataFrame operators: joins, merges, comparisons, aggregates, windows, rankings and vector search."""
