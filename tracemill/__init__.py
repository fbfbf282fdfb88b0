"""File-operation telemetry analytics as Spark DataFrame operators."""
