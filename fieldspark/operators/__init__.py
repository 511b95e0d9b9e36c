"""Relational operators on DataFrames: projection, joins, windows, reshaping, sampling."""
