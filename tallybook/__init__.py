"""Member-tab analytics on Spark: balances, revenue, statements, community, change batches."""
