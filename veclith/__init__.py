"""Quantized vector analytics on Spark DataFrames."""
