"""plantflow: building-telemetry analytics expressed as Spark DataFrame plans."""
