"""Analytics for two-speaker conversation corpora on Spark."""
