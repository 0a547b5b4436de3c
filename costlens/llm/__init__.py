"""Operations of a training-data pipeline: near-duplicates, scoring, filtering, encoding, sharding, search."""
