"""Operator 10: mix sources to target weights.

Tokens (runs of other than white space) are summed for each source over all documents. A
source's rate is its target share of the token total over what it has; each document is
emitted floor(rate) times and once more where a hash of (seed, doc_id) is below the
fraction. Target shares come from ``weights`` (by source, made to add up to 1; a source that
isn't named gets 0), or are in proportion to tokens ** alpha where none are given.

The per-source table is written to the shared folder and read again, so Catalyst knows its
size: a few sources are broadcast, millions of them are joined by a shuffle.

Defined cases: documents whose source is NULL form a source of their own; NULL or empty text
counts no tokens, and a very long one as many as it has; a source without tokens has the rate 0 with ``weights`` and without;
however small another source's rate is, it isn't rounded to 0; repeated rows are emitted alike, as they share their hash; a NULL doc_id is hashed as
``\\N``, any other by its string, so it may be of any type; there are no ties, as no row is compared with another; an empty table gives an empty one; the columns of ``docs`` pass through, whatever
their names, and ``copy`` and ``rate`` must name none of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, prepare, staged, unit, unit_sql

ALPHA, SEED = 0.5, 17
WORD = r"[^ \t\n\r]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens, rate)."""
    per = docs.groupBy(col(source).alias("source")).agg(F.sum(token_count(col(text))).alias("tokens"))
    if weights is None:
        share = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(F.when(F.col("source").isNotNull(), F.try_element_at(given, F.col("source"))), F.lit(0.0))
    share = F.when(F.col("tokens") > 0, share).otherwise(0.0)
    per = staged(per.withColumn("share", share), "mix-sources")
    totals = per.agg(F.sum("tokens").alias("t"), F.sum("share").alias("s"))
    rate = F.when((F.col("tokens") > 0) & (F.col("s") > 0), F.col("t") * F.col("share") / F.col("s") / F.col("tokens")).otherwise(0.0)
    return per.crossJoin(F.broadcast(totals)).select("source", "tokens", rate.alias("rate"))  # totals is one row


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED, source: str = "source", text: str = "text", key: str = "doc_id", copy: str | None = None, rate: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its source's rate asks; ``copy`` and ``rate`` name columns to add."""
    prepare(docs.sparkSession)
    taken = {x.lower() for x in docs.columns} & {x.lower() for x in (copy, rate) if x}
    if taken or (copy and rate and copy.lower() == rate.lower()):
        raise ValueError(f"there is a column {sorted(taken) or copy} already; name another with copy= and rate=")
    s, r, n, c = fresh(docs, "mix_source", "mix_rate", "mix_n", "mix_copy")
    per = staged(rates(docs, weights, alpha, source, text), "mix-rates").select(F.col("source").alias(s), F.col("rate").alias(r))
    u = unit(F.concat(F.lit(f"{seed}|"), F.coalesce(col(key).cast("string"), F.lit("\\N"))))
    times = F.floor(r).cast("int") + F.when(u < F.col(r) - F.floor(r), 1).otherwise(0)
    out = docs.join(per, col(source).eqNullSafe(F.col(s))).withColumn(n, times).where(F.col(n) > 0)
    out = out.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*[col(x) for x in docs.columns], *([F.col(c).alias(copy)] if copy else []), *([F.col(r).alias(rate)] if rate else []))


def mix_sql(alpha: float = ALPHA, seed: int = SEED) -> str:
    u = unit_sql(f"'{seed}|' || coalesce(d.doc_id::VARCHAR, '\\N')")
    return f"""
    WITH d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS tokens FROM documents),
    per AS (SELECT source, sum(tokens)::BIGINT AS tokens, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {alpha}) ELSE 0.0 END AS share FROM d GROUP BY source),
    tot AS (SELECT sum(tokens)::BIGINT AS t, sum(share) AS s FROM per),
    r AS (SELECT source, CASE WHEN tokens > 0 AND s > 0 THEN t * share / s / tokens ELSE 0.0 END AS rate FROM per, tot),
    n AS (SELECT d.doc_id, d.source, r.rate, (floor(rate) + CASE WHEN {u} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS n FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, source, round(rate, 6) AS rate, unnest(range(1, n + 1))::INTEGER AS copy_no FROM n
    """
