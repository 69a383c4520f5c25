"""Spreadsheet semantics and table analytics on PySpark."""
