"""Training-data operators: ten operators and a document pipeline.

Nothing outside this subpackage imports it.  Each operator module keeps its
own general interface (real texts, spans, identifiers); ``queries`` derives
the registered digest columns from it and ``oracle`` holds the SQL.
"""
