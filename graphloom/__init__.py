"""Property-graph analytics on Spark: graphs, evidence, connections, risk."""
