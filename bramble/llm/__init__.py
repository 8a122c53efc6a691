"""Operators for preparing training text. Nothing outside this subpackage imports it.

Every operator is a function of DataFrames; `queries` in this package registers one query per operator.
On a cluster, ship the package to the executors (installed, or with --py-files).
"""
