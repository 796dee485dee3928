"""Functions of the query language over typed values."""
