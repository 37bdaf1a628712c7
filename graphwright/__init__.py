"""Knowledge-graph analytics and text-corpus operators on Spark DataFrames."""
