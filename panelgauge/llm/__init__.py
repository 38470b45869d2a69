"""Training-data operators for large corpora. Nothing else in the package imports this one."""
