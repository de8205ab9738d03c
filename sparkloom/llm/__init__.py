"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when present.
"""
