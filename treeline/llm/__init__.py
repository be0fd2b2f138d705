"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; :mod:`treeline.llm.queries` derives the registered query results.
"""
