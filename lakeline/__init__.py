"""Spark-native jobs for a small data lake: logs, payrolls, enrolments and sensors."""
