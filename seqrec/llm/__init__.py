"""Operators for preparing training text and vectors at scale; see queries.py for the registered ones."""
