"""Operators for preparing training corpora at scale.

Every module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the driver tables. Nothing else
in the library imports this subpackage.
"""
