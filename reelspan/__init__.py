"""Timeline transcript analytics on Spark."""
