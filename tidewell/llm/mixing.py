"""Mixing sources to target weights by iterative proportional fitting.

Main path in DataFrame functions only. Documents are summed to cells of
source, language and topic; the cells' token weights are raked to the target
of each margin in turn; documents are then sampled by calibrated
probabilities. Where a cell would need more tokens than it has, all of its
documents are kept and repeated, or carry the rest as a weight over one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import cut, read_table, small, stored

DIMS = ("tw_source", "tw_lang", "tw_topic")
TEMPER = 0.7
SWEEPS = 40
SWEEPS_A_STEP = 5
TOLERANCE = 1e-12
MAX_CELLS = 100_000


def text_topic(text: Column) -> Column:
    """The form of a text, which stands for its topic in tables without a
    topic column: ``table``, ``short``, ``list`` or ``prose`` (null: ``short``)."""
    size, lines = F.octet_length(text), F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.coalesce(size, F.lit(0)) < 500, "short")
        .when(size < 120 * lines, "list")
        .otherwise("prose")
    )


def token_weight(text: Column) -> Column:
    """Four bytes a token, at least one for any text; 0 for null or empty."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def rake(cells: DataFrame, dims: tuple[str, ...] = DIMS, temper: float = TEMPER, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``cells`` (``dims``, ``tokens``) with ``raked`` token weights and the
    greatest relative ``residual`` of any margin.

    ``targets`` may give, for a dimension, a table of its values and
    ``share``; without one, a value's target share is its token share to the
    power ``temper``. Shares of values that no cell holds are left out, the
    others scaled to the total; values without a target get none, as do cells
    without tokens. Sweeps end when all margins hold to ``TOLERANCE``, or
    after ``sweeps`` of them where targets contradict each other; the residual
    tells which. Sums run over windows of the cells, which are no more than the
    different combinations of values.
    """
    now = cut(cells.withColumn("raked", F.col("tokens").cast("double")))
    count, total = now.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    for dim in dims:
        held = now.groupBy(dim).agg(F.sum("tokens").cast("double").alias("held")).where("held > 0")
        if targets and dim in targets:
            given = targets[dim].select(F.col(dim).alias("given"), F.col("share").cast("double").alias("share"))
            share = held.join(given, held[dim].eqNullSafe(given["given"])).select(dim, "share")
        else:
            share = held.select(dim, F.pow("held", F.lit(temper)).alias("share"))
        share = cut(share)
        whole = share.agg(F.sum("share")).first()[0] or 1.0
        goal = share.select(F.col(dim).alias("goal_of"), (F.col("share") / F.lit(float(whole)) * F.lit(float(total or 0))).alias(f"goal_{dim}"))
        now = now.join(goal, now[dim].eqNullSafe(goal["goal_of"]), "left").drop("goal_of").withColumn(f"goal_{dim}", F.coalesce(f"goal_{dim}", F.lit(0.0)))

    def sums(dim: str) -> Column:
        return F.sum("raked").over(Window.partitionBy(dim))

    residual = F.greatest(*[F.when(F.col(f"goal_{d}") > 0, F.abs(sums(d) / F.col(f"goal_{d}") - 1)).otherwise(0.0) for d in dims], F.lit(0.0))
    now, left, done = stored(now.coalesce(1) if count <= MAX_CELLS else now, "raked"), None, 0
    while done < sweeps and (left is None or left > TOLERANCE):
        now = now.coalesce(1) if count <= MAX_CELLS else now  # few rows: all windows run in one task, without a shuffle
        for _ in range(min(SWEEPS_A_STEP, sweeps - done)):
            for dim in dims:
                now = now.withColumn("raked", F.when(sums(dim) > 0, F.col("raked") * F.col(f"goal_{dim}") / sums(dim)).otherwise(0.0))
            done += 1
        now = stored(now, "raked")
        left = now.select(residual.alias("residual")).agg(F.max("residual")).first()[0] or 0.0
    return now.select(*cells.columns, "raked", F.lit(left or 0.0).alias("residual"))


def mix(docs: DataFrame, source: Column | None = None, lang: Column | None = None, topic: Column | None = None, tokens: Column | None = None, temper: float = TEMPER, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None, seed: str = "") -> DataFrame:
    """``docs`` with ``tw_topic, tw_tokens, tw_ratio, tw_probability,
    tw_weight, tw_selected, tw_copies`` (columns of these names are replaced).

    ``tw_ratio`` is the cell's raked over natural token weight; a document is
    sampled with probability min(1, ratio), by a hash of its doc_id, and
    weighs ratio / probability, so that weighted sums meet the targets in
    expectation. ``tw_copies`` does the same without weights: the whole part of
    the ratio, and one more with the probability of the rest. Null source or language is a value of its own. Cells without
    tokens have ratio 1. Rows with equal doc_ids fare alike.
    """
    rows = docs.withColumns(
        {
            "tw_source": F.col("source") if source is None else source,
            "tw_lang": F.col("lang") if lang is None else lang,
            "tw_topic": text_topic(F.col("text")) if topic is None else topic,
            "tw_tokens": token_weight(F.col("text")) if tokens is None else tokens,
        }
    )
    cells = rows.groupBy(*DIMS).agg(F.sum("tw_tokens").alias("tokens"))
    raked = rake(cells, DIMS, temper, sweeps, targets)
    ratio = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0)
    factor = small(raked.select(*[F.col(d).alias(f"c_{d}") for d in DIMS], ratio.alias("tw_ratio")))
    on = [rows[d].eqNullSafe(factor[f"c_{d}"]) for d in DIMS]
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = rows.join(factor, on[0] & on[1] & on[2]).drop(*[f"c_{d}" for d in DIMS])
    chance = F.least(F.lit(1.0), F.col("tw_ratio"))
    return joined.withColumns(
        {
            "tw_probability": chance,
            "tw_weight": F.when(chance > 0, F.col("tw_ratio") / chance).otherwise(0.0),
            "tw_selected": draw < F.round(chance, 6),
            "tw_copies": (F.floor(F.round("tw_ratio", 6)) + (draw < F.round(F.round("tw_ratio", 6) - F.floor(F.round("tw_ratio", 6)), 6)).cast("long")).cast("long"),
        }
    )


def sample_mixed(docs: DataFrame) -> DataFrame:
    """The sampled rows of ``mix``, each as often as ``tw_copies`` says, with
    the columns of ``docs``: its plain token shares meet the targets in
    expectation."""
    used = ("doc_id", "text", "source", "lang")
    others = [c for c in docs.columns if c not in used]
    row = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []
    chosen = mix(docs.select(*used, *row)).where("tw_copies > 0").withColumn("tw_copies", F.explode(F.array_repeat(F.lit(0), F.col("tw_copies").cast("int"))))
    return chosen.select(*[F.col(c) if c in used else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities, weights and copies of all of ``documents``;
    for nulls, empties, repeats and empty tables see ``mix``."""
    return mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "source",
        "lang",
        F.col("tw_topic").alias("topic"),
        F.col("tw_tokens").alias("tokens"),
        F.round("tw_probability", 6).alias("probability"),
        F.round("tw_weight", 6).alias("weight"),
        F.col("tw_selected").alias("selected"),
        F.col("tw_copies").alias("copies"),
    )


def mixing_sql(docs: str = "documents", temper: float = TEMPER, sweeps: int = SWEEPS) -> str:
    """DuckDB SQL of ``mix`` over a table or CTE of documents, as CTEs that
    end with ``mixed``."""
    dims = ("source", "lang", "topic")
    steps, last = [], "w0"
    for k in range(sweeps * 3):
        d = dims[k % 3]
        steps.append(f"w{k + 1} AS (SELECT source, lang, topic, tokens, CASE WHEN sum(raked) OVER (PARTITION BY {d}) > 0 THEN raked * goal_{d} / sum(raked) OVER (PARTITION BY {d}) ELSE 0 END AS raked, goal_source, goal_lang, goal_topic FROM {last})")
        last = f"w{k + 1}"
    goals = ", ".join(f"g_{d} AS (SELECT {d}, pow(sum(tokens), {temper}) / (SELECT sum(p) FROM (SELECT pow(sum(tokens), {temper}) AS p FROM cells GROUP BY {d})) * (SELECT sum(tokens) FROM cells) AS goal_{d} FROM cells GROUP BY {d})" for d in dims)
    return f"""
rows_ AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN coalesce(octet_length(encode(text)), 0) < 500 THEN 'short'
    WHEN octet_length(encode(text)) < 120 * (length(text) - length(replace(text, chr(10), '')) + 1) THEN 'list' ELSE 'prose' END AS topic,
  CAST(ceil(coalesce(octet_length(encode(text)), 0) / 4.0) AS BIGINT) AS tokens FROM {docs}),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL),
{goals},
w0 AS (SELECT c.source, c.lang, c.topic, tokens, tokens AS raked, goal_source, goal_lang, goal_topic FROM cells c
  JOIN g_source a ON a.source IS NOT DISTINCT FROM c.source JOIN g_lang b ON b.lang IS NOT DISTINCT FROM c.lang JOIN g_topic t ON t.topic IS NOT DISTINCT FROM c.topic),
{", ".join(steps)},
mixed AS (SELECT r.*, least(1.0, ratio) AS p, CASE WHEN ratio > 0 THEN ratio / least(1.0, ratio) ELSE 0 END AS weight,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < round(least(1.0, ratio), 6) AS selected,
    CAST(floor(round(ratio, 6)) AS BIGINT) + CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < round(round(ratio, 6) - floor(round(ratio, 6)), 6) AS BIGINT) AS copies
  FROM rows_ r JOIN (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN raked / tokens ELSE 1 END AS ratio FROM {last}) f
  ON f.source IS NOT DISTINCT FROM r.source AND f.lang IS NOT DISTINCT FROM r.lang AND f.topic IS NOT DISTINCT FROM r.topic)"""


OP5_SQL = f"""WITH {mixing_sql()}
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, round(weight, 6) AS weight, selected, copies FROM mixed"""
