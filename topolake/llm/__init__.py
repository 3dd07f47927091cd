"""Training-data operators: filters, classifiers, deduplication, mixing and packing.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; it selects the columns it needs first, so further columns,
whatever their names, pass by unseen.
"""
