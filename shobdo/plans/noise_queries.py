"""Queries of the noise operators over corpus_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import DUCK, nested
from ..operators import noise


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/corpus_records.parquet")


def _noise_query(noise_type: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = noise.perturb(records(spark, sf_dir).select("record_id", "text").where("text is not null"), noise_type, [1, 3, 5], [42])
        return df.select("record_id", "severity", "n_eligible", "n_requested", "n_applied", "submodes", "unchanged", F.md5("noised").alias("noised_md5"))

    return query


def _noise_sql(noise_type: str) -> str:
    src = "SELECT record_id, nfc_normalize(text) AS t FROM corpus_records WHERE text IS NOT NULL"
    units = nested(src, noise.unit_steps(DUCK, noise_type), "*")
    grid = noise.grid_sql([1, 3, 5], [42])
    return nested(f"SELECT * FROM ({units}) CROSS JOIN ({grid}) g", noise.rewrite_steps(DUCK, noise_type),
                  "record_id, severity, n_eligible, n_requested, n_applied, submodes, unchanged, md5(noised) AS noised_md5")


QUERIES, SQL = {}, {}
for _k, _type in enumerate(maps.NOISE_TYPES, 1):
    QUERIES[f"noise_n{_k}"] = _noise_query(_type)
    SQL[f"noise_n{_k}"] = _noise_sql(_type)


def _emoji_query(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = noise.emoji_transform(records(spark, sf_dir).select("record_id", "text").where("text is not null"), mode)
        return df.select("record_id", "n_eligible", "n_applied", F.md5("noised").alias("noised_md5"))

    return query


for _mode in ("keep", "remove", "replace_with_text"):
    _name = f"emoji_{_mode.split('_')[0]}"
    QUERIES[_name] = _emoji_query(_mode)
    SQL[_name] = nested("SELECT record_id, nfc_normalize(text) AS t FROM corpus_records WHERE text IS NOT NULL", noise.emoji_steps(DUCK, _mode),
                        "record_id, n_eligible, n_applied, md5(noised) AS noised_md5")
