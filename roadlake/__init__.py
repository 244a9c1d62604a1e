"""Fleet telemetry on Spark: decode, clean, summarise, report and alert."""
