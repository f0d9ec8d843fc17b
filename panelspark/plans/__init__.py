from . import describe, market, models, panel  # noqa: F401
