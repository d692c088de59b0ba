"""Writers: partitioned tables, write-if-changed, receipts, JSON and CSV exports."""
