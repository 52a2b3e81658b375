"""Operators on galleries: DataFrames of ``id, label, path, embedding`` and code words."""
