"""lodestone: DataFrame-first analytics over typed documents, entities and owners."""
