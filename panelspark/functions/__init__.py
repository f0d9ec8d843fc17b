from . import aggregates, names, solar, timeparts, units  # noqa: F401
