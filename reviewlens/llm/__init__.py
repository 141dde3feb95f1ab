"""Operators for preparing large text corpora.

One module per operator, plus ``queries`` (the registered ``opN_*`` queries
and their SQL). Nothing else in the library imports this package; it only
borrows the library's session helpers.
"""
