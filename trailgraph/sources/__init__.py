"""Readers that turn files, logs and tables into the engine's DataFrames."""
