"""Market-data analytics on Spark: bars, indicators, microstructure, risk, drift, quality, features."""
