"""The queries of the training-data problems, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import clusters, level
from gridloom.llm import mix as mixing
from gridloom.llm import neighbours, tokens
from gridloom.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = clusters.cluster_records(table(spark, folder, "sysembeddings"))
    return found.where("size >= 5").select("cluster_id", F.col("id").alias("record_id"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sysembeddings")
    return clusters.describe_clusters(rows, clusters.cluster_records(rows))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.pairs(p7_neighbours(spark, folder))


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "sysembeddings"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    counts = mixing.sized_once(tokens.token_counts(table(spark, folder, "documents"), ["doc_id", "source"]))
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(counts, targets, total=mixing.listed_tokens(counts, targets) if whole else None)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_mix(spark, folder), table(spark, folder, "mix_targets"))


def p9_whole_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mix as large as the listed sources' documents: scarce sources fall short, and the report shows it."""
    return mixing.shares(_mix(spark, folder, whole=True), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_levels(spark, folder).select("doc_id", "level_no")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return level.reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clusters, p7_found, p7_neighbours, p8_ids, p9_mix, p9_shares, p9_whole_shares, p10_found, p10_levels)}

_VECTORS = """
vectors AS (
    SELECT DISTINCT ON (id) id, table_name, entity_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
    FROM sysembeddings WHERE id IS NOT NULL AND len(embedding) = 384
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

#: Quadratic: for small data only. Token ids, mixes and reading levels are beyond SQL.
SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_VECTORS},
        links AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.table_name = b.table_name AND list_dot_product(a.v, b.v) >= 0.70),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT min(b) AS cluster_id, a AS record_id FROM reach GROUP BY a HAVING count(*) >= 5""",
    "p7_found": f"""WITH {_VECTORS},
        near AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS c FROM vectors a JOIN vectors b
            ON (a.table_name, a.entity_id) IS DISTINCT FROM (b.table_name, b.entity_id)),
        best AS (SELECT a, b FROM near WHERE c >= 0.70 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM best""",
    "p7_neighbours": f"""WITH {_VECTORS},
        near AS (SELECT a.id AS id, b.id AS neighbour, round(list_dot_product(a.v, b.v), 6) AS cosine FROM vectors a JOIN vectors b
            ON (a.table_name, a.entity_id) IS DISTINCT FROM (b.table_name, b.entity_id))
        SELECT id, neighbour, cosine FROM near WHERE cosine >= 0.70 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) <= 5""",
}
