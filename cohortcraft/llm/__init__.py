"""Training-data operators on Spark DataFrames (nothing else imports this)."""
