"""Credit-risk features, validation and scoring as Spark DataFrame plans."""
