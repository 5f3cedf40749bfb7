"""Table-in, table-out operators of the clone engine."""
