"""veldgraph: graph queries, rules, history and references over Spark DataFrames."""
