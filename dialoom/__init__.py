"""Dialogue, questionnaire and training-data analytics on Spark DataFrames."""
