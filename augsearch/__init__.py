"""augsearch: table-augmentation search expressed as Spark DataFrame jobs."""
