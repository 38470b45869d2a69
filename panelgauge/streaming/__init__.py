"""Extension: completeness of an append-only panel."""
