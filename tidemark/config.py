"""Limits and constants of the market engine (fixed values where results depend on them)."""

from statistics import NormalDist

TRADING_DAYS = 252
MAX_DAILY_RETURN = 0.25
MIN_DAILY_VOLUME = 100_000
MAX_MISSING_RATIO = 0.05
MAX_GAP = 3
INITIAL_CAPITAL = 1_000_000.0
RISK_FREE_DAILY = 0.00015
SPREAD_BPS = 10.0
COMMISSION = 0.005
TRAIN, TEST, STEP, PURGE = 252, 63, 63, 5
VAR_LIMIT, CONFIDENCE = 0.02, 0.95
STOCK_LIMIT, SECTOR_LIMIT = 0.05, 0.25
DRAWDOWN_LIMIT = 0.05
Z95 = -NormalDist().inv_cdf(1 - CONFIDENCE)
PDF95 = NormalDist().pdf(Z95)
#: The fixture's sector dimension: ticker, sector; tickers that aren't here are in Other.
SECTORS = (("AMERICA", "West"), ("EUROPE", "West"), ("ASIA", "East"), ("AFRICA", "East"))
