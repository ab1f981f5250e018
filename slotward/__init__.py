"""slotward: fleet-health analytics expressed as Spark DataFrame jobs."""
