"""Event-locked analytics on Spark: time series sliced around events, joined, modelled and tested."""
