"""Clinical record analytics on Spark: records in, knowledge graph and derived tables out."""
