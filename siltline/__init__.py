"""siltline: log normalisation and analytics as PySpark DataFrames."""
