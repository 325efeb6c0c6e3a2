"""Operations of a training-data pipeline, each a Spark job over whole tables."""
