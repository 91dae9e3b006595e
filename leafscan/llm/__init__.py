"""Operators of a training-data pipeline over the tables of documents and conversations.

Every operator takes a DataFrame with the columns it names and ignores all others, so extra
columns, also ones named like its results, change nothing.
"""
