"""Operators of a training-data pipeline over ``documents(doc_id, text, lang, source, ...)``.

Nothing else in the library imports this package.
"""
