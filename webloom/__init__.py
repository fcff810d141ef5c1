"""A PySpark engine for crawling, indexing, searching and preparing web text."""
