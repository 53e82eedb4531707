"""Fixed word lists, tables and weights. Results depend on these exact values."""
