"""Press-coverage analytics as set-based PySpark jobs."""
