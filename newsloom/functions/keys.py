"""Article and image keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_sha256(link: Column) -> Column:
    """Key of the first table generation."""
    return F.sha2(link, 256)


def link_md5(link: Column, length: int = 32) -> Column:
    """Key of the second table generation; `length` keeps a prefix of the digest."""
    return F.substring(F.md5(link), 1, length)


def object_key(hash_id: Column) -> Column:
    """Name of a stored header image."""
    return F.concat(F.lit("s3_"), hash_id, F.lit(".png"))


def experiment_key(article_hash: Column, n_chunks: Column) -> Column:
    return F.concat(article_hash, F.lit("_n_chunks_"), n_chunks.cast("string"))
