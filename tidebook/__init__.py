"""Order-book and trade analytics on Spark."""
