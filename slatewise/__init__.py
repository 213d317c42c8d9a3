"""slatewise: listwise ranking analytics on Spark DataFrames.

A *slate* is the list of items shown for one search. Every operator takes and
returns DataFrames; nothing here runs per-row Python.
"""
