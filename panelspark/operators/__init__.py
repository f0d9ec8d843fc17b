from . import chunks, cumulative, dedupe, frequency, grid, joins, quality, reshape, weighted  # noqa: F401
