"""Explicit schemas of the input tables; nothing is inferred on read."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SYSTEM_LOG = _schema(("sn", T.StringType()), ("time", T.TimestampType()),
                     ("msg", T.StringType()), ("server_model", T.StringType()))
LABELS = _schema(("sn", T.StringType()), ("fault_time", T.TimestampType()),
                 ("label", T.IntegerType()))
SUBMIT = _schema(("sn", T.StringType()), ("fault_time", T.TimestampType()))
CRASHDUMP = SUBMIT
VENUS = _schema(("sn", T.StringType()), ("fault_time", T.TimestampType()),
                ("module", T.StringType()))
IMPORTANCE = _schema(("importance", T.DoubleType()), ("feature", T.StringType()))

# Columns of the feature table that are identifiers and stay strings. Fixed values.
CATEGORICAL_FEATURES = (
    "server_model", "last_msg_id", "last_template_id",
    "tmp_appearance_1", "tmp_appearance_2", "tmp_appearance_3",
    "msg_appearance_1", "msg_appearance_2", "msg_appearance_3",
    "max_continuous_msg",
)
KEY_COLUMNS = ("sn", "fault_time", "label")


def feature_schema(columns):
    """Schema of a stored feature table: ids are strings, the rest doubles."""
    kinds = {"sn": T.StringType(), "fault_time": T.TimestampType(), "label": T.IntegerType()}
    kinds.update({name: T.StringType() for name in CATEGORICAL_FEATURES})
    return _schema(*[(name, kinds.get(name, T.DoubleType())) for name in columns])
