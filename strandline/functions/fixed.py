"""Names, limits and preset tables that results must agree on."""

from __future__ import annotations

import math

# --- fixed values: sources and series -------------------------------------------------------------
SOURCES = ("yfinance", "fred", "worldbank")
REQUIRED_RAW = {
    "yfinance": ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"),
    "fred": ("Date", "Value"),
    "worldbank": ("economy", "Date", "Value"),
}
REQUIRED_STAGED = {
    "yfinance": ("close", "date", "ingested_at", "source_system", "volume"),
    "fred": ("date", "source_system", "value"),
    "worldbank": ("date", "economy", "source_system", "value"),
}
COLUMN_ALIASES = {
    "yfinance": {
        "date": "Date", "datetime": "Date", "index": "Date", "open": "Open", "high": "High", "low": "Low",
        "close": "Close", "adj close": "Adj Close", "adjclose": "Adj Close", "adjusted close": "Adj Close",
        "volume": "Volume",
    },
    "fred": {"date": "Date", "index": "Date", "value": "Value"},
    "worldbank": {"economy": "economy", "country": "economy", "date": "Date", "time": "Date", "value": "Value"},
}
MACRO_SERIES = {
    "CPIAUCSL": "inflation", "PNRGINDEXM": "energy_index", "UNRATE": "unemployment_rate",
    "FEDFUNDS": "fed_funds_rate", "DGS10": "us10y_treasury_yield", "VIXCLS": "vix_index",
    "UMCSENT": "consumer_sentiment", "INDPRO": "industrial_production",
}
INDICATORS = {
    "NY.GDP.MKTP.KD.ZG": "gdp_growth", "EG.USE.PCAP.KG.OE": "energy_usage", "FP.CPI.TOTL.ZG": "inflation_wb",
    "SL.UEM.TOTL.ZS": "unemployment_wb", "NE.TRD.GNFS.ZS": "trade_openness",
}
MARKET_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume", "log_return", "ticker")
RATE_WORDS = ("rate", "yield", "inflation", "unemployment", "growth", "sentiment", "spread")
RETURN_WORDS = ("return", "pct_change", "diff")
NATIVE_HORIZON = {"yfinance": 1, "fred": 21, "worldbank": 252}
PUBLICATION_LAG_ROWS = 45

# --- fixed values: series contracts ---------------------------------------------------------------
# source, entity (NULL = default of the source), kind, unit, null tolerance %, z limit, winsorise
CONTRACT_COLUMNS = ("source", "entity", "kind", "unit", "null_tolerance_pct", "z_limit", "winsorise")
CONTRACTS = (
    ("yfinance", None, "price_series", "absolute_price", 10.0, 4.0, True),
    ("fred", None, "macro_level", "index_or_level", 25.0, 4.5, True),
    ("fred", "inflation", "macro_rate", "percentage", 20.0, 4.0, True),
    ("fred", "energy_index", "macro_index", "index_or_level", 25.0, 5.0, False),
    ("fred", "vix_index", "risk_sentiment", "index_or_level", 20.0, 6.0, False),
    ("fred", "fed_funds_rate", "policy_rate", "percentage", 20.0, 5.0, True),
    ("fred", "us10y_treasury_yield", "yield_curve", "percentage", 20.0, 5.0, True),
    ("worldbank", None, "macro_structural", "level", 45.0, 5.5, False),
    ("worldbank", "gdp_growth", "macro_growth", "percentage", 40.0, 5.0, False),
    ("worldbank", "energy_usage", "macro_usage", "level", 50.0, 6.0, False),
)
CONTRACT_DEFAULT = ("unknown", "unknown", 30.0, 4.5, True)
PERCENT_ENTITIES = {"fred": ("inflation", "unemployment_rate"), "worldbank": ("gdp_growth",)}

# --- fixed values: limits of the cleaning layer ---------------------------------------------------
MIN_ROWS = 10
MIN_ROWS_SHARE = 0.1
HISTORY_ROWS = 20
NULL_LIMIT_CEILING = 70.0
WARN_TO_FAIL_BUFFER = 15.0
OUTLIER_WARN_RATIO = 0.1
MAX_DAILY_MOVE = 0.95
INDICATOR_NULL_SHARE = 0.3
SCHEMA_COLUMNS = {"yfinance": 9, "fred": 3, "worldbank": 4}
AUDIT_COLUMNS = 7

# --- fixed values: limits of the wide table -------------------------------------------------------
RETURN_CLIP = math.log(1.25)
MACRO_TOLERANCE_DAYS = 120
INDICATOR_TOLERANCE_DAYS = 730
NULL_ALERT_PCT = 20.0
PROXY_CLIP = 0.08

# --- fixed values: stress scenarios ---------------------------------------------------------------
SCENARIO_SHOCKS = (
    ("geopolitical_conflict", "energy_index", 0.25), ("geopolitical_conflict", "inflation", 0.02),
    ("geopolitical_conflict", "log_return", -0.15),
    ("monetary_tightening", "fed_funds_rate", 0.015), ("monetary_tightening", "gdp_growth", -0.01),
    ("tech_correction", "log_return", -0.30),
    ("stagflation", "inflation", 0.05), ("stagflation", "gdp_growth", -0.01), ("stagflation", "log_return", 0.0),
    ("liquidity_freeze", "us10y_treasury_yield", 0.01), ("liquidity_freeze", "consumer_sentiment", -0.10),
    ("liquidity_freeze", "log_return", -0.18),
    ("commodity_super_spike", "energy_index", 0.35), ("commodity_super_spike", "inflation", 0.03),
    ("commodity_super_spike", "log_return", -0.10),
    ("supply_chain_dislocation", "energy_index", 0.18), ("supply_chain_dislocation", "inflation", 0.015),
    ("supply_chain_dislocation", "industrial_production", -0.02), ("supply_chain_dislocation", "log_return", -0.08),
    ("sovereign_debt_stress", "us10y_treasury_yield", 0.02), ("sovereign_debt_stress", "consumer_sentiment", -0.12),
    ("sovereign_debt_stress", "gdp_growth", -0.015), ("sovereign_debt_stress", "log_return", -0.14),
)
# scenario, correlation breakdown strength, drift shift, volatility multiplier, first-day jump, sector
SCENARIO_COLUMNS = ("scenario", "breakdown", "drift_shift", "vol_multiplier", "jump_shock", "sector_scope")
SCENARIOS = (
    ("geopolitical_conflict", 0.35, -0.0010, 1.45, -0.12, None),
    ("monetary_tightening", 0.25, -0.0006, 1.20, -0.05, None),
    ("tech_correction", 0.40, -0.0012, 1.35, -0.20, "Technology"),
    ("stagflation", 0.30, -0.0008, 1.30, -0.08, None),
    ("liquidity_freeze", 0.45, -0.0014, 1.55, -0.15, None),
    ("commodity_super_spike", 0.30, -0.0007, 1.40, -0.09, None),
    ("supply_chain_dislocation", 0.33, -0.0005, 1.25, -0.07, None),
    ("sovereign_debt_stress", 0.42, -0.0011, 1.50, -0.13, None),
)
STRESSED_CORRELATION = 0.85

# --- fixed values: normal distribution ------------------------------------------------------------
Z_05 = -1.6448536269514722
ES_FACTOR_05 = 2.0627128075074257
TRADING_DAYS = 252
