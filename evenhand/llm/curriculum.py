"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in order of their name share `share` times all words by their weights; no source
gets more than `cap` times its own words, the excess goes to the others by weight.

Curriculum: training time runs from 0 to 1. Source s is drawn at the rate
w_s(t) = target_s (1 + tilt_s (1 - 2 t)); its integral, the cumulative demand
C_s(t) = target_s (t + tilt_s (t - t^2)), reaches target_s at 1. Every draw of a document, one for
each pass over its source (documents in hash order, pass after pass), has a place in the demand of
its source, which is inverted, t = C_s^-1(u); draws, or documents by their first draw, are
range-sorted by t. What the mix takes of a document is what its draws take.

All of it is DataFrame work. The running sums inside a source go by hash slices: sums of slices
first, then inside each slice, so a source with most rows burdens no task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint, text_key

WEIGHTS = (5, 2, 1)
TILTS = (0.5, 0.0, -0.5)
SHARE = 1.5
CAP = 2.0
SLICES = 4_096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _in_cycle(place: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, tilt) of (source, source_size), one row per source.
    A source is "s" and its name, or "z" for null, so that names keep their order and null is last.

    With the sources in order of cap / weight, the first k are held at their caps and the others
    get the same words per unit of weight; k is the least for which this holds (later ones give
    less).  Only this table
    of one row per source passes a window without partitions.
    """
    place = F.row_number().over(W.orderBy("source")) - 1
    rows = sizes.withColumn("place", place).withColumns(
        {"weight": _in_cycle(F.col("place"), weights).cast("double"), "tilt": _in_cycle(F.col("place"), tilts)}
    )
    rows = rows.withColumn("most", cap * F.col("source_size").cast("double"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    rows = rows.withColumn("level", F.when(level <= F.col("most") / F.col("weight"), level))
    rows = rows.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", F.coalesce(target, F.col("most")).alias("target"), "tilt")


def _drawn(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    tilts: Sequence[float] = TILTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, its hash `order`, `draws` (an array of
    pass, words, position), then a struct `row` of the columns `keep`."""
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("z")).alias("source"),
        words_in(F.col(text)).alias("size"),
        F.md5(F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("null")), text_key(F.col(text)))).alias("order"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    rows = rows.withColumn("slice", F.substring("order", 1, 3))
    if not keep:
        rows = checkpoint(rows)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"), F.count("*").alias("n"))
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    goals = targets(sizes, weights, tilts, share, cap)
    goals = slices.join(goals, "source").select(
        "source", "slice", "slice_start", "source_size", "target", "tilt"
    )
    joined = rows.join(goals, ["source", "slice"])
    inside = W.partitionBy("source", "slice").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    found = joined.withColumn("start", start)
    # whole passes, then the words of the last pass that fall into this document
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    last = F.round(F.col("target")).cast("long") - full * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("start")))
    found = found.withColumns({"full": full, "last": last})
    passes = F.when(F.col("size") > 0, F.col("full") + (F.col("last") > 0).cast("long")).otherwise(F.lit(0))
    # C(t) = u  <=>  tilt t^2 - (1 + tilt) t + u / target = 0, the root in [0, 1]
    slope = 1 + F.col("tilt")

    def draw(place: Column) -> Column:
        u = (F.col("start") + place * F.col("source_size")) / F.col("target")
        inverse = 2 * u / (slope + F.sqrt(F.greatest(F.lit(0.0), slope * slope - 4 * F.col("tilt") * u)))
        words = F.when(place < F.col("full"), F.col("size")).otherwise(F.col("last"))
        return F.struct(place.alias("pass"), words.alias("words"), inverse.alias("position"))

    places = F.filter(F.sequence(F.lit(0).cast("long"), passes), lambda place: place < passes)
    extra = ["row"] if keep else []
    return found.select("doc_id", "size", "source_size", "target", "order", F.transform(places, draw).alias("draws"), *extra)


def mix(docs: DataFrame, keep: Sequence[str] = (), **options) -> DataFrame:
    """One row per document, range-sorted by its first draw's training position, documents not taken
    last: doc_id, size, source_size, target, taken, position (of its first pass, null if not taken),
    passes, `draws` (pass, words, position of every pass over it), then a struct `row` of the columns
    `keep`. Options name the columns id, text and source, and give weights, tilts, share and cap.

    A source's words are taken pass by pass in the order of a hash of id and text; the last pass
    ends inside a document, of which the rest is not taken. Null sources form one source, the
    last; null texts have no words and are never taken. Equal rows are interchangeable. An empty
    table gives no rows.
    """
    found = _drawn(docs, keep=keep, **options).withColumns(
        {
            "taken": F.aggregate("draws", F.lit(0).cast("long"), lambda words, d: words + d["words"]),
            "position": F.get("draws", F.lit(0))["position"],
            "passes": F.size("draws").cast("long"),
        }
    )
    extra = ["row"] if keep else []
    return found.orderBy(F.asc_nulls_last("position"), "order").select(
        "doc_id", "size", "source_size", "target", "taken", "position", "passes", "draws", *extra
    )


def training_order(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The columns of `docs`: a row for every pass over a taken document, range-sorted by the
    training position of that pass."""
    found = _drawn(docs, text=text, keep=docs.columns, **options)
    found = found.select("row", F.explode("draws").alias("draw"))
    return found.orderBy("draw.position").select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(md5(text), 'null'))) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (
  SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, [0.5, 0.0, -0.5][place % 3 + 1]::DOUBLE AS tilt,
         {CAP} * source_size::DOUBLE AS most
  FROM p
),
l AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
),
m AS (SELECT max(level) FILTER (WHERE level <= most / weight) AS level FROM l),
g AS (SELECT source, source_size, coalesce(least(most, m.level * weight), most) AS target, tilt FROM l, m),
x AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.tilt,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         floor(g.target / greatest(g.source_size, 1)) AS f
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
),
y AS (
  SELECT *, CAST(f * size + greatest(0, least(size, round(target) - f * source_size - start)) AS BIGINT) AS taken, start / target AS u FROM x
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       CASE WHEN taken > 0 THEN round(2 * u / ((1 + tilt) + sqrt(greatest(0.0, (1 + tilt) * (1 + tilt) - 4 * tilt * u))), 9) END AS position
FROM y
"""
