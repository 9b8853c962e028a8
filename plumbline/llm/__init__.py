"""Training-data operators: dedup, decontamination, extraction, packing and token output.

Nothing else in the library imports this subpackage. Each module holds one
operator, its thin registered query and, where SQL can express it, the SQL.
"""
