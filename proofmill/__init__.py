"""Evidence-grounded claim analytics on Spark DataFrames."""
