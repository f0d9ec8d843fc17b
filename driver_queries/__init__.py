"""The package's operators over the driver's tables, each with its SQL counterpart."""

from . import aggregates, calendars, ingest, joins, market, models, study, windows  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
