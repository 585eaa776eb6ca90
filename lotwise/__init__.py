"""Ledger analytics on Spark: DataFrame operators for trades, lots, prices, returns and notes."""
