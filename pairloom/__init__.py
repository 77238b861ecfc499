"""pairloom: paired-text datasets and training corpora on Spark DataFrames."""
