"""Column expressions: no job, no shuffle, usable on batch and streaming DataFrames alike."""
