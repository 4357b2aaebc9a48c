"""Schemas of the tables the readers produce."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRINGS = T.ArrayType(_S)
LOCATION = table(path=_S, line=_I, symbol=_S, symbol_kind=_S)

MANIFEST_FILE = table(kind=_S, lang=_S, include_in_architecture=_B, include_in_test_support=_B)
SIGNATURE = table(name=_S, line=_I, parent=_S)
DEPENDENCY = table(target=_S, weight=_I)
FINDING = table(
    id=_S, path=_S, severity=_S, dimension=_S, metric=_S, symbol=_S, value=_S, threshold=_S, message=_S
)
EVENT = table(
    generated_at=T.TimestampType(),
    mode=_S,
    review_type=_S,
    scores=T.MapType(_S, _D),
    concern_counts=table(total=_L, top=_L, limit=_L),
    top_concerns=T.ArrayType(table(concern_id=_S, kind=_S, level=_S, confidence=_D, location=LOCATION)),
    artifacts=T.MapType(_S, _S),
)
FEEDBACK = table(
    advice_id=_S, concern_id=_S, kind=_S, path=_S, symbol=_S, status=_S, scope=_S, pattern=_S, reason=_S
)
