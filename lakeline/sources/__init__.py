"""Sources: text, CSV and JSON files, message topics, tables and collections."""

from lakeline.sources.files import (
    read_csv,
    read_envelope_files,
    read_key_values,
    read_lake_rejects,
    read_lines,
    read_lines_without,
    read_sensor_csv,
    read_sensor_json,
    read_sensor_lake,
    stream_sensor_lake,
)
from lakeline.sources.inference import column_types, infer_schema, profile_csv, type_changes
from lakeline.sources.json_arrays import json_objects, read_json_objects, read_json_readings
from lakeline.sources.kafka import kafka_options, read_kafka
from lakeline.sources.stores import jdbc_options, read_docs, read_jdbc, read_target, read_whole

__all__ = [
    "column_types",
    "infer_schema",
    "json_objects",
    "jdbc_options",
    "kafka_options",
    "profile_csv",
    "read_csv",
    "read_docs",
    "read_envelope_files",
    "read_jdbc",
    "read_kafka",
    "read_json_objects",
    "read_json_readings",
    "read_key_values",
    "read_lake_rejects",
    "read_lines",
    "read_lines_without",
    "read_sensor_csv",
    "read_sensor_json",
    "read_sensor_lake",
    "read_target",
    "read_whole",
    "stream_sensor_lake",
    "type_changes",
]
