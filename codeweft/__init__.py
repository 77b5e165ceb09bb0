"""codeweft: code analysis over Spark DataFrames."""
