"""Training-data operators: search, mixing, filters, scans, counting, archives, joins and packing."""
