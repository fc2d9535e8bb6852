"""Usage-ledger analytics on Spark: sources, dedup, reports, pricing, forecasts and sinks as DataFrame plans."""
