"""A log and table query engine on Spark."""
