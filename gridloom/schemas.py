"""The system tables and the feed of change events."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType

_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "boolean": BooleanType(),
    "instant": TimestampNTZType(),
    "floats": ArrayType(FloatType()),
    "bigints": ArrayType(LongType()),
    "changes": MapType(StringType(), StructType([StructField("old", StringType()), StructField("new", StringType())])),
}


def _schema(text: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


SYSTEM: dict[str, StructType] = {
    name: _schema(text)
    for name, text in {
        "sysEmbeddings": "Id string, TableName string, EntityId string, Embedding floats",
        "sysTimeseriesBaseValues": "Id string, TableName string, EntityId string, PropertyName string, Value string, Timestamp instant",
        "sysTimeseriesDeltas": "Id string, BaseValueId string, StartMs bigint, Deltas bigints, LastTimestamp bigint, Version int",
        "sysChangeLog": "Id string, TableName string, EntityId string, ChangedBy string, PropertyName string, ChangedAt instant, OriginalValue string, NewValue string, ChangeType string",
        "sysIntegrityLog": "Id string, TableName string, EntityId string, PropertyName string, Hash string, PreviousHash string, Timestamp instant",
        "sysAnalytics": "Id string, Name string, Value string, Interval int, LastRun instant, Embeddable boolean, Status string",
        "sysAnalyticsSteps": "Id string, AnalyticsId string, Order int, Operation string, Expression string, ResultVariable string, MaxLoop int",
    }.items()
}
#: The feed of change events, one directory of files that streams read.
EVENTS = _schema("EventId string, TableName string, EntityId string, Operation string, Changed changes, Timestamp instant")


def schema_of(text: str) -> StructType:
    """A schema of `name kind, ...`, with the kinds string, int, bigint, boolean, instant and floats."""
    return _schema(text)
