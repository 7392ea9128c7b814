"""Operators for preparing training data: sharding, dedup, extraction, mixing, packing.

Nothing outside this subpackage imports it.
"""
