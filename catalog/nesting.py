"""Nested columns: embeddings as arrays, conversations as arrays of structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load, rounded, u_sql, union_all
from catalog.fabrication import SEED, normal_sql
from twintable.plans import nested
from twintable.plans.fabricate.table import Options, fabricate

#: Fabricated rows for each row of the reference.
TIMES = 3


def _talks(spark, d):
    turn = F.struct("turn", "role", F.length("text").cast("long").alias("chars"))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def profile_nested(spark, d):
    vectors = nested.profile_nested(load(spark, d, "embeddings").select("vec_id", "embedding"))
    both = vectors.unionByName(nested.profile_nested(_talks(spark, d)))
    return rounded(both, min=6, max=6, mean=6, std=6)


def _path_sql(path: str, kind: str, value: str, measure: str | None, source: str, distinct: bool = True) -> str:
    m = measure or "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{path}' AS path, '{kind}' AS type, count(*) AS n_total, count(*) FILTER ({value} IS NULL) AS n_missing,
  {f'count(DISTINCT {value})' if distinct else 'CAST(NULL AS BIGINT)'} AS n_distinct, round(min({m})::DOUBLE, 6) AS min,
  round(max({m})::DOUBLE, 6) AS max, round(avg({m}::DOUBLE), 6) AS mean, round(stddev_pop({m}::DOUBLE), 6) AS std FROM {source}"""


TALKS = "(SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1)"
PROFILE_SQL = union_all([
    _path_sql("vec_id", "bigint", "vec_id", "vec_id", "embeddings"),
    _path_sql("embedding", "array<float>", "len(embedding)", "len(embedding)", "embeddings"),
    _path_sql("embedding[]", "float", "v", "v", "(SELECT unnest(embedding) AS v FROM embeddings)"),
    _path_sql("conv_id", "bigint", "conv_id", "conv_id", TALKS),
    _path_sql("turns", "array<struct<turn:bigint,role:string,chars:bigint>>", "size", "size", TALKS),
    _path_sql("turns[]", "struct<turn:bigint,role:string,chars:bigint>", "conv_id", None, "conversations", False),
    _path_sql("turns[].turn", "bigint", "turn", "turn", "conversations"),
    _path_sql("turns[].role", "string", "role", "length(role)", "conversations"),
    _path_sql("turns[].chars", "bigint", "length(text)", "length(text)", "conversations"),
])


def fabricate_nested(spark, d):
    """Conversations with drawn numbers of turns, and every turn's fields."""
    talks = _talks(spark, d)
    twin = fabricate(talks, TIMES * talks.count(), Options(seed=SEED))
    return twin.select("conv_id", F.posexplode_outer("turns").alias("place", "t")).select("conv_id", "place", "t.*")


def _whole_sql(path: str, stats: str) -> str:
    draw = normal_sql(path, "place || '.0'", "place || '.1'")
    return f"round_even(least(greatest({stats}.m + {stats}.s * {draw}, {stats}.lo), {stats}.hi), 0)::BIGINT"


def _pick_sql(name: str, value: str, source: str, order: str) -> str:
    """Values with the stretch of the running count that each stands for."""
    return f"""{name} AS (SELECT {value} AS v, sum(count(*)) OVER (ORDER BY {order}) - count(*) AS lo,
  sum(count(*)) OVER (ORDER BY {order}) AS hi, sum(count(*)) OVER () AS tot FROM {source} GROUP BY {value})"""


FABRICATE_SQL = f"""
WITH {_pick_sql('sizes', 'size', TALKS, 'size')}, {_pick_sql('roles', 'role', 'conversations', 'md5(role), role')},
a AS (SELECT avg(turn) AS m, stddev_pop(turn) AS s, min(turn) AS lo, max(turn) AS hi FROM conversations),
b AS (SELECT avg(length(text)) AS m, stddev_pop(length(text)) AS s, min(length(text)) AS lo, max(length(text)) AS hi FROM conversations),
r AS (SELECT range AS row_id FROM range(0, (SELECT {TIMES} * count(DISTINCT conv_id) FROM conversations))),
n AS (SELECT row_id, v AS size FROM r JOIN sizes ON floor({u_sql(SEED, 'turns', 'row_id', "'length'")} * tot) >= lo
  AND floor({u_sql(SEED, 'turns', 'row_id', "'length'")} * tot) < hi),
t AS (SELECT row_id, unnest(range(0, size)) AS place FROM n)
SELECT row_id + 1 AS conv_id, place::INT AS place, {_whole_sql('turns[].turn', 'a')} AS turn, v AS role,
  {_whole_sql('turns[].chars', 'b')} AS chars
FROM t JOIN roles ON floor({u_sql(SEED, 'turns[].role', 'row_id', "place || '.0'")} * tot) >= roles.lo
  AND floor({u_sql(SEED, 'turns[].role', 'row_id', "place || '.0'")} * tot) < roles.hi, a, b"""

QUERIES = {
    "profile_nested": (profile_nested, PROFILE_SQL),
    "fabricate_nested": (fabricate_nested, FABRICATE_SQL),
}
