"""Training-data operators over document and conversation tables.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`txstrata.llm.queries` binds them to the tables.
"""
