"""Training-data operators over a ``documents`` table (doc_id, text, ...).

Each module holds one operator; ``queries`` registers one query per operator.
Nothing else in the library imports this package.
"""
