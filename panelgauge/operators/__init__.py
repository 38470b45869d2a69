"""Operators over panels: audit, strata, reliability, planning, batches, votes, fits, resampling."""
