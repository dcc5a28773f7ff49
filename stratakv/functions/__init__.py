"""Column functions: the clock, sizes and formats, and generators."""
