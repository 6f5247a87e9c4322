"""benchsieve: benchmark analytics for language-model logs, written as Spark jobs."""
