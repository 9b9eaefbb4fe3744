"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are gathered in cells (one for each combination of source, language and topic). Each step of a
sweep scales the cells of one dimension so that its marginal meets the target. The number of sweeps is fixed, so that results can
be written out in SQL; `deviation` says how far the marginals still are from their targets. Documents are then sampled, each on its own, with the probability that its cell's weight asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

DIMENSIONS, SWEEPS, POWER, KEEP = ("source", "lang", "topic"), 6, 0.7, 0.7


def topic(text: Column) -> Column:
    """The layout that a text has, as its topic."""
    has = lambda s: F.instr(text, s) > 0
    return F.when(has(" | "), "table").when(has("###") | has("***"), "symbols").when(has("!!"), "shouting").otherwise("prose")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def tempered(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """(dimension, share): targets in proportion to a power of the marginal token count."""
    own = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("mass"))
    return own.crossJoin(own.agg(F.sum("mass").alias("whole"))).select(dimension, (F.col("mass") / F.col("whole")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (dimensions, tokens > 0) with weight: positive numbers that sum to one and whose marginals meet
    the targets (dimension, share) after the last sweep exactly for the last dimension, and for the others
    as far as the cells allow. Values without a target get weight zero. Cells are aggregates, one row per
    combination of values; every three sweeps they are written to the shared folder.
    """
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"))
    now = cells.crossJoin(F.broadcast(whole)).select(*cells.columns, (F.col("tokens") / F.col("whole")).alias("weight"))
    for d, target in targets.items():
        now = now.join(target.select(d, F.col("share").alias(f"share{d}")), d, "left")
    now = stored(now, "cells")
    for k in range(sweeps):
        for d in targets:
            have = F.sum("weight").over(Window.partitionBy(d))
            now = now.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"share{d}") / F.nullif(have, F.lit(0.0)), F.lit(0.0)))
        if k % 3 == 2:
            now = stored(now, "cells")
    return now.select(*cells.columns, "weight")


def deviation(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance of a marginal of the weights from its target."""
    per = [raked.groupBy(d).agg(F.sum("weight").alias("w")).join(t, d).agg(F.max(F.abs(F.col("w") - F.col("share"))).alias("x")) for d, t in targets.items()]
    return max(p.first().x or 0.0 for p in per)


def mix(docs: DataFrame, keep: float = KEEP, dimensions: tuple[str, ...] = DIMENSIONS, power: float = POWER, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The sampled documents with n_words and prob, the probability with which each was taken.

    prob = least(1, keep * weight * all tokens / tokens of the cell): of the tokens, about `keep` stay (less
    where a cell would have to be repeated to meet its weight). A dimension `topic` that docs lack is the layout of
    the text. Null values of a dimension are a value of their own. Texts without words count one token, so
    that their cell exists. The sample depends on ids only: rows of one id stay or go together.
    """
    have = docs.withColumn("n_words", n_words(F.col(text_col)))
    if "topic" in dimensions and "topic" not in docs.columns:
        have = have.withColumn("topic", topic(F.col(text_col)))
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(f"__tm_{d}") for d in dimensions]
    own = [f"__tm_{d}" for d in dimensions]
    cells = have.select(*keys, F.greatest("n_words", F.lit(1)).alias("t")).groupBy(*own).agg(F.sum("t").alias("tokens"))
    cells = stored(cells, "cells")
    raked = rake(cells, {d: tempered(cells, d, power) for d in own})
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"))
    probs = raked.crossJoin(F.broadcast(whole)).select(*own, F.least(F.lit(1.0), F.lit(keep) * F.col("weight") * F.col("whole") / F.col("tokens")).alias("prob"))
    joined = have.drop("prob").withColumns({f"__tm_{d}": F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in dimensions}).join(probs, own)
    return joined.where(uniform(F.col(id_col)) < F.col("prob")).select(*docs.drop("prob", "n_words").columns, "n_words", "prob")


def oracle(keep: float = KEEP, sweeps: int = SWEEPS, power: float = POWER) -> str:
    """DuckDB SQL for mix() over documents: the sweeps written out."""
    parts = [
        r"""d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
 coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
 CASE WHEN instr(text, ' | ') > 0 THEN 'table' WHEN instr(text, '###') > 0 OR instr(text, '***') > 0 THEN 'symbols'
 WHEN instr(text, '!!') > 0 THEN 'shouting' ELSE 'prose' END AS topic FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(greatest(n_words, 1))::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c)",
    ]
    for x in DIMENSIONS:
        parts.append(f"t_{x} AS (SELECT {x}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS share FROM c GROUP BY {x})")
    n = 0
    for _ in range(sweeps):
        for x in DIMENSIONS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens, weight * share / sum(weight) OVER (PARTITION BY w.{x}) AS weight FROM w{n} w JOIN t_{x} t ON t.{x} = w.{x})")
            n += 1
    parts.append(f"p AS (SELECT *, least(1.0, {keep} * weight * sum(tokens) OVER () / tokens) AS prob FROM w{n})")
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT doc_id, n_words, round(prob, 6) AS prob FROM d JOIN p USING (source, lang, topic)"
        "\nWHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < p.prob"
    )
