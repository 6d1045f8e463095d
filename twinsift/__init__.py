"""Near-duplicate analytics and entity resolution, declared as Spark DataFrame plans."""
