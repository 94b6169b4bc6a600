"""Volatility-anomaly research on Spark: panels in, long tables out.

Ticker, month, portfolio, model, lookback and subperiod are grouping keys of
lazy DataFrame jobs; nothing panel-sized passes through the driver.
"""

__version__ = "0.1.0"
