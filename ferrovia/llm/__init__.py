"""Operators for preparing text corpora for language-model training.

Nothing outside this package imports it; ``queries()`` and ``oracle_sql()`` in
:mod:`ferrovia.llm.registry` list what it offers to the driver.
"""
