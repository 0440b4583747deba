"""Training-data operators: licence scans, fingerprints, quality rules, packing, joins, extraction, models and scans.

Nothing else in the library imports this package. Each module keeps its operator; ``queries`` holds the registered
queries, which derive their contract columns from the operators' outputs.
"""
