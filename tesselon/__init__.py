"""Spark-native analytics for planar windows and their objects.

Everything is DataFrame in, DataFrame out; nothing here depends on the ``llm``
subpackage, which holds the corpus operators and may be absent.
"""
