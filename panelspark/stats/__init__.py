from . import absorb, distributions, event_study, tables, terms, wls  # noqa: F401
