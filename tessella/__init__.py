"""Fine-tuning data preparation and model scoring as Spark DataFrame jobs."""
