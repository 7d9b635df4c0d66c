"""Stand-in inputs over the star-schema tables, the query catalogue, and its SQL twins."""
