"""Measurement-reliability analytics for repeated-judgement panels on Spark DataFrames."""
