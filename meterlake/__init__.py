"""Token-usage accounting and analytics as Spark DataFrames."""
