"""Training-data operators on Spark DataFrames: quality, toxicity, dedup,
decontamination, extraction, formatting, tokenisation, search and LM scoring.

Nothing outside this subpackage imports it.
"""
