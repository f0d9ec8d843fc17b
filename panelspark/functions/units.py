"""Unit conversion factors, in one place."""

KG_PER_T = 1000.0
G_PER_KG = 1000.0
WH_PER_KWH = 1000.0
KWH_PER_MWH = 1000.0
MWH_PER_TWH = 1_000_000.0
MINUTES_PER_HOUR = 60
MINUTES_PER_HALF_HOUR = 30
HOURS_PER_DAY = 24
HALF_HOURS_PER_DAY = 48
# 1 MJ = 10^6 W s
KWH_PER_MJ = 1000.0 / 3600.0
DISPATCH_MINUTES = 5
