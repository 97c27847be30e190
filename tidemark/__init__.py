"""Volatility, option, hedging and point-in-time market-data analytics on Spark DataFrames."""
