"""tidemark: a key-value changelog engine expressed as Spark DataFrames.

An ordered log of SET / GET / DELETE commands is parsed, resolved and stored
with DataFrame operations only; see the README for the layout of the package.
"""
