"""Operators on DataFrames: joins, windows, aggregates and state, one module per area."""
