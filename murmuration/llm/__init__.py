"""Corpus preparation for language-model training data: ten operators as Spark jobs.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; :mod:`murmuration.llm.queries` has the thin queries.
"""
