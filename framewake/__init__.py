"""framewake: Spark-first analytics for timed metadata carried in motion-video streams."""
