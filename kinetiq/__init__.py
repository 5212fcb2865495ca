"""kinetiq: movement analytics over tables and streams of frames, as Spark DataFrame operators."""
