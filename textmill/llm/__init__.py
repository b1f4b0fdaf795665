"""Operators for preparing training data. Nothing outside this subpackage imports it.

Each module holds one operator with a general interface; ``queries`` derives the
registered queries from them and ``oracle`` holds the matching SQL.
"""
