"""An engine for equality-shaped filters over wide tables, on Spark."""
