"""logweave: indexing, search and record processing for conversation logs on PySpark.

DataFrames in, DataFrames out.  The training-data operators over text live in
``logweave.llm``; nothing outside that subpackage imports it.
"""

__version__ = "0.1.0"
