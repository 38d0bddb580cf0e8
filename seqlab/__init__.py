"""seqlab: labelled event-sequence analytics expressed on Spark DataFrames."""
