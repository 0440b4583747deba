"""Document-analytics engine on PySpark: every operator is a DataFrame-to-DataFrame function."""
