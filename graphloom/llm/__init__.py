"""Training-data operators: quality, dedup, decontamination, extraction, mixing, output.

Nothing outside this subpackage imports it, so the folder can be removed whole.
"""
