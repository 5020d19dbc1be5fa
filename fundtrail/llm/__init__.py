"""Operators for preparing training text: documents, pages and benchmarks in, decisions out."""
