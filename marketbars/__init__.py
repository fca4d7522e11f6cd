"""marketbars: time-series market data on Spark tables and streams."""
