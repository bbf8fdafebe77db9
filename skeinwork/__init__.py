"""skeinwork: a Spark-first engine that turns conversational text into grounded, deduplicated knowledge."""
