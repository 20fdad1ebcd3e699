"""Code-graph analytics as Spark DataFrame programs."""
