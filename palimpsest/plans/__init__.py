"""What runs on the driver: compaction plans, transactions, the store, and the queries."""
