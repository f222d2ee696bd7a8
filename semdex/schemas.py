"""Schemas of the index's tables and results."""

from pyspark.sql import types as T

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


REPOS = _struct(id=_L, name=_S, path=_S, indexed_at=T.TimestampType())
FILES = _struct(file_path=_S, mtime=_D)
CHUNKS = _struct(id=_L, repo_id=_L, file_path=_S, line_start=_I, line_end=_I, content=_S, lang=_S, file_mtime=_D)
VECTORS = _struct(chunk_id=_L, repo_id=_L, embedding=T.ArrayType(T.FloatType()))
BANDS = _struct(chunk_id=_L, repo_id=_L, band_idx=_I, band_hash=T.BinaryType())
META = _struct(key=_S, value=_S, version=_L)
RESULTS = _struct(repo=_S, path=_S, line=_I, score=_D, snippet=_S, lang=_S)
_SIDE = _struct(repo=_S, path=_S, line_start=_I, line_end=_I, snippet=_S, lang=_S)
PAIRS = _struct(chunk_a=_SIDE, chunk_b=_SIDE, similarity=_D)
