"""Operators for the preparation of training text, and their queries.

Each module holds one operator, its registered query and, where SQL can
express it, the SQL that checks it. Nothing else in the package imports this
folder.
"""
