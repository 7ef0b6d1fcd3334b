"""Column functions: no shuffle, no Python worker, usable in batch and streaming plans."""
