"""offerloom: evidence -> catalog -> offers analytics, expressed as Spark DataFrames."""
