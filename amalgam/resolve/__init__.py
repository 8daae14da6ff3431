"""Resolution of records into entities: blocking, signals, decisions, clusters, golden records."""
