"""PII detection and de-identification on Spark DataFrames."""
