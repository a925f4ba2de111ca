"""tidemark: point-in-time panel analytics and data preparation as Spark plans."""
