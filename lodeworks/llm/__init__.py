"""Training-data operators: dedup, filters, classifiers, mixing and output.

Nothing outside this package imports it; deleting the folder leaves the rest
of the engine working.
"""
