"""Training-data operators: filtering, deduplication, mixing and encoding of text corpora.

Every module works on plain DataFrames and names its key and text columns as parameters.
"""
