"""A Spark-first engine for curating question/answer text and evaluating predictions on it."""
