"""Household-survey income analytics on Spark DataFrames."""
