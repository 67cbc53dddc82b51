"""Types, filters, links between columns and duplicates."""
