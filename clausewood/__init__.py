"""clausewood: a PySpark engine for corpora of marked-up legal documents.

Documents are read as rows, parsed into one nested schema, exploded into
relational tables and checked by rules written as DataFrame queries.
"""
