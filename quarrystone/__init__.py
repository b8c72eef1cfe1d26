"""quarrystone: curation, sequence and metric queries on Spark DataFrames."""
