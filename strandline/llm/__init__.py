"""Operators of a training-data pipeline on the tables documents, embeddings, pages and labels.

Nothing else in the package imports this folder; `queries` holds the registered forms of the operators.
"""
