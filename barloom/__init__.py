"""Daily market-bar research on Spark: standardization, point-in-time valuation,
windowed features, first-hit labels, walk-forward evaluation and decisions."""
