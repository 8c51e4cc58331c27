"""Queries over the driver's tables, and their SQL counterparts.

The driver's tables hold no source trees, so each query first derives one from
them; the derived corpus grows with the tables.
"""
