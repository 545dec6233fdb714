"""Quirelight: documents to structured, annotated text, as PySpark DataFrame operators."""
