"""Explicit schemas of all tables that stages exchange; nothing is inferred from CSV."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


ARCHIVE_IMAGE = _table(member_path=S, mode=S, split=S, class_id=S, class_label=S, filename=S, sample_id=S, file_size=L, compress_size=L)
MANIFEST = _table(dataset_doi=S, class_id=S, class_label=S, split=S, sample_id=S, mode=S, archive_member=S, local_relative_path=S, bytes=L, sha256=S)
CATALOG = _table(sample_id=S, mode=S, split=S, class_name=S, path=S, extension=S, file_size_bytes=L)
QUALITY = T.StructType(CATALOG.fields + _table(width=I, height=I, brightness=D, contrast=D, sharpness=D, automatic_quality_ok=B, review_required=B, automatic_status=S, quality_flags=S, read_error=S).fields)
QUALITY_REVIEW = _table(mode=S, split=S, class_name=S, sample_id=S, manual_decision=S, review_notes=S)
NEAR_DUPLICATE = _table(mode=S, class_id=S, split_a=S, sample_id_a=S, split_b=S, sample_id_b=S, archive_member_a=S, archive_member_b=S, distance=I)
NEAR_DUPLICATE_KEY = ["mode", "class_id", "split_a", "sample_id_a", "split_b", "sample_id_b"]
NEAR_DUPLICATE_REVIEW = T.StructType([f for f in NEAR_DUPLICATE.fields if f.name in NEAR_DUPLICATE_KEY] + _table(decision=S, notes=S).fields)
EMBEDDINGS = _table(embedding_row=L, sample_id=S, mode=S, split=S, class_name=S, path=S, embedding=T.ArrayType(T.FloatType()))
