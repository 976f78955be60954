"""veriref: checking bibliographic references at corpus scale, on Spark DataFrames."""
