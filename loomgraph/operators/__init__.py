"""Graph, path, keyword and lookup operators on DataFrames."""
