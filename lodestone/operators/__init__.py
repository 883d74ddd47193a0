"""One module per family of problems. Operators take DataFrames with explicit ids and return DataFrames."""
