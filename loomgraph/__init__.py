"""loomgraph: typed property graphs and text tables as Spark DataFrames."""
