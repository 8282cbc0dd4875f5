"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with target share w of all bytes gets the mean repetition rate w * total / own bytes. Every document draws its
count from a Poisson distribution with that mean, inverting the distribution function at a uniform number hashed from
(seed, doc_id); the document is exploded by its count and the copies are shuffled globally by a second hash. Rates have no limit: a Poisson
number of a rate above MAX_RATE is the sum of independent draws of equal rates of at most MAX_RATE each.

Sources are not limited in number: up to ``BROADCAST_SOURCES`` rates are broadcast, beyond that they reach the documents through a join spread over salts, so that a source with a
third of all rows is spread as well. Copies are dealt to partitions by their hash and sorted inside them, which is a random order of all copies.

Defined cases: a null source is a source of its own; weights are relative and a source without one gets none of the mix; sources whose texts are all empty or null have a rate of 0;
repeated rows of one doc_id draw the same count; null doc_ids hash as -1; an empty table gives no rows. ``docs`` may have any other columns: they are kept, but for those
named mix_rate, mix_count and mix_copy, whose places the results take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

SALTS = 64
SEED = "mix-1"
#: The largest rate of one draw.
MAX_RATE = 50.0
#: Sources whose rates and distribution functions (at most 1.5 kB each) are broadcast.
BROADCAST_SOURCES = 4096


def uniform(key: Column, seed: str | Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("-1")), F.lit(":"), seed if isinstance(seed, Column) else F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Distribution function of Poisson(rate) at 0, 1, ..., until its rest is below the resolution of ``uniform``."""
    top = (rate + F.lit(10) * F.sqrt(rate) + F.lit(25)).cast("int")
    one = lambda acc, k: F.struct((acc["term"] * rate / k).alias("term"), (acc["sum"] + acc["term"] * rate / k).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + acc["term"] * rate / k)).alias("all"))
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), top), start, one)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(mix_source, rate): of every source; equal weights if none are given."""
    sums = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("own"))
    if weights is None:
        sums = sums.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, weight double")
        sums = sums.join(given, F.col("mix_source").eqNullSafe(F.col("given")), "left").select("mix_source", "own", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_ = sums.agg(F.sum("own").alias("total"), F.sum("weight").alias("weights"))
    rate = F.when((F.col("own") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * F.col("total") / F.col("own")).otherwise(0.0)
    return sums.join(F.broadcast(all_)).select("mix_source", rate.alias("rate"))  # all_ is one row


def with_counts(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """docs with mix_rate and mix_count."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("mix_rate", "mix_count")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE)).cast("int"))
    steps = source_rates(docs, weights).withColumn("mix_draws", draws).withColumn("mix_steps", poisson_steps(F.col("rate") / F.col("mix_draws")))
    right = scratch.save(steps.select(*[F.col(c).alias(f"{c}__mix") for c in ("mix_source", "rate", "mix_draws", "mix_steps")]), "rates")  # names that no column of docs has
    same = docs["source"].eqNullSafe(F.col("mix_source__mix"))
    if right.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(right), same)
    else:
        right = right.withColumn("mix_salt__mix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(right, same & (F.pmod(F.xxhash64(docs["doc_id"]), F.lit(SALTS)).cast("int") == F.col("mix_salt__mix")))
    drawn = lambda u: F.size(F.filter("mix_steps__mix", lambda c: c <= u))
    rate, n = F.col("rate__mix"), F.col("mix_draws__mix")
    first = drawn(uniform(docs["doc_id"], seed))
    more = F.transform(F.sequence(F.lit(2), n), lambda k: uniform(docs["doc_id"], F.concat(F.lit(f"{seed}:"), k.cast("string"))))
    count = F.when(rate > 0, F.when(n > 1, first + F.aggregate(more, F.lit(0), lambda acc, u: acc + drawn(u))).otherwise(first)).otherwise(0)
    return joined.select(*[docs[c] for c in docs.columns], rate.alias("mix_rate"), count.alias("mix_count"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """docs repeated to the target weights, in hash order, with mix_rate, mix_count and mix_copy (from 1)."""
    copies = with_counts(docs.drop("mix_copy"), weights, seed).where("mix_count > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mix_copy"))
    return copies.withColumn("place__mix", place).repartition("place__mix").sortWithinPartitions("place__mix", "doc_id", "mix_copy").drop("place__mix")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", F.col("mix_copy").alias("copy"), F.round("mix_rate", 9).alias("rate"), F.octet_length("text").cast("long").alias("n_bytes"))


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    uniform_sql = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-1') || ':{SEED}' || CASE WHEN draw > 1 THEN ':' || draw ELSE '' END), 1, 13))::BIGINT)::DOUBLE / 4503599627370496"
    return f"""
WITH RECURSIVE s AS (SELECT source, sum(coalesce(strlen(text), 0)) own FROM documents GROUP BY source),
a AS (SELECT source, CASE WHEN own > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM s) * (SELECT sum(own) FROM s) / own ELSE 0 END rate FROM s),
r AS (SELECT source, rate, greatest(1, ceil(rate / {MAX_RATE}))::INT draws, rate / draws AS part FROM a),
p(source, part, k, term, cum) AS (
  SELECT source, part, 0, exp(-part), exp(-part) FROM r WHERE rate > 0
  UNION ALL SELECT source, part, k + 1, term * part / (k + 1), cum + term * part / (k + 1) FROM p WHERE k < floor(part + 10 * sqrt(part) + 25)),
d AS (SELECT row_number() OVER () AS place, doc_id, r.source, rate, strlen(text) n_bytes, unnest(range(1, draws + 1)) AS draw FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
u AS (SELECT *, {uniform_sql} AS u FROM d),
c AS (SELECT place, doc_id, u.source, n_bytes, rate, count(*) n FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cum <= u.u GROUP BY ALL)
SELECT doc_id, source, unnest(range(1, n + 1))::INT AS copy, round(rate, 9) AS rate, n_bytes::BIGINT AS n_bytes FROM c"""
