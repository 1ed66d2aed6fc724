"""Entity linking over large text collections as lazy Spark DataFrames."""
