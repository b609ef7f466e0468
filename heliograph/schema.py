"""Schemas of the catalogue, and constants of its values."""

from pyspark.sql import types as T

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: phash: 20 longs, four rotations of five words each; null where there is none.
IMAGES = _struct(
    id=_L, path=_S, content_hash=_S, file_size=_L, mtime=_L, width=_I, height=_I, format=_S, nsfw_score=_D, nsfw_tile_mean=_D, blur_score=_D,
    exif_taken=_L, exif_camera=_S, thumb_path=_S, analyzed_at=_L, dupe_checked_at=_L, dupe_checked_kinds=_I, phash=T.ArrayType(_L),
)
DUPE_GROUPS = _struct(id=_L, kind=_S, similarity=_S)
DUPE_MEMBERS = _struct(group_id=_L, image_id=_L, is_keeper=_B)
EXPORT_RUNS = _struct(id=_L, started_utc=_L, finished_utc=_L, destination=_S, mode=_S, structure=_S, reject_action=_S, status=_S)
EXPORT_ITEMS = _struct(run_id=_L, image_id=_L, dest_path=_S, status=_S, skip_reason=_S, error=_S)
META = _struct(key=_S, value=_S)
UNDO_LOG = _struct(id=_L, batch_id=_S, op=_S, original_path=_S, new_location=_S, ts_utc=_L, restored=_I, content_hash=_S)
EDGES = _struct(a=_L, b=_L, distance=_I)

#: Kinds of groups, their bits in dupe_checked_kinds, and their rank in reconciliation.
EXACT, VARIANT, BURST = "exact", "variant", "burst"
KIND_BITS = {EXACT: 1, VARIANT: 2, BURST: 4}
KIND_RANK = {EXACT: 0, BURST: 1, VARIANT: 2}
#: Kinds whose extras a bulk action takes.
BULK_KINDS = (EXACT, VARIANT)

#: A signature has 272 bits (17 rows of 16 comparisons) in five words for each rotation.
BITS, WORDS, ROTATIONS = 272, 5, 4
