"""Batch jobs over product names and text corpora, written on Spark DataFrames."""
