"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``queries`` lists what it offers to
``__spark_entry__``.
"""
