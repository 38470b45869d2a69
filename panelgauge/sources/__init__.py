"""Panel sources and outcome codings."""
