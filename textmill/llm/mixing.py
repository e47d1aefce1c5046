"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, native.

Every document draws an exponential key, divided by its quality weight: the order
of the keys is a weighted sample without replacement. A source gets complete
epochs first, then the documents with the least keys until its budget is full.
The prefix sums need no sort of a whole source: keys fall into buckets by their
logarithm, bucket sums are added up (some ten thousand rows a source), and rows are
summed within their bucket only. The logarithm of an exponential draw has a density
under 0.37 wherever its weight shifts it, so no bucket holds more than 0.37 / ``STEPS``
of a source, whatever the weights are. A source with a third of all rows is thus
dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import WORD, settle, table

#: Buckets for each unit of a key's natural logarithm.
STEPS = 2048
#: Buckets in a coarse one.
COARSE = 256
#: The least weight; a document without a weight has it.
LEAST = 0.05


def quality_weight(text: Column, size: Column) -> Column:
    """Quality of a text of ``size`` words, from 0.05 to 1: its share of words of letters, less its symbols a word."""
    n = F.greatest(size, F.lit(1)).cast("double")
    letters = F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+")), F.lit(0)) / n
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0)) / n
    return F.greatest(F.lit(LEAST), F.least(F.lit(1.0), letters) * F.greatest(F.lit(0.0), 1.0 - symbols))


def bucket_of(key: Column) -> Column:
    """Buckets in the order of the keys."""
    return F.floor(F.ln(key) * STEPS).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Budget of each source: ``source, sid, source_size, target``.

    ``sizes`` has ``source, size``. The sources themselves are few enough to be one
    task's rows: a row of four numbers each. Weights repeat over the sources in the order
    of their code points, null last. No source gets more than ``cap`` times its
    size; what it can't use is shared out by weight among the others: the budgets
    are the level of water that fills capped vessels.
    """
    total = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    every = Window.partitionBy()
    named = total.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), "sid")
    named = named.withColumn("all", F.sum("source_size").over(every))
    named = named.withColumn("filled", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = named.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    named = named.withColumn("level", (F.col("all") - F.col("filled")) / F.col("rest"))
    named = named.withColumn("level", F.coalesce(F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(every), F.lit(0.0)))
    return named.select("source", "sid", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """How often each document goes into the mix.

    Returns ``doc_id, size, source_size, target, copies, taken``, a row for each
    input row: words of the text, words and budget of its source, and how many
    times it is taken. The fractional epoch takes whole documents in the order of
    their keys as long as their middle lies within the budget, so a source misses
    its target by half a document at most. Null and empty texts have size 0, a null
    source is a source of its own; repeated rows count each. An empty table gives an
    empty result. The draw depends on the seed and the id, without an id on the text;
    rows that share it are summed in one task, in the order of id and size. A weight
    under 0.05 or null counts as 0.05.
    Columns named in ``carry`` come along, others are ignored.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    # A null id draws by the text, so that rows without ids do not all draw alike.
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double")
    base = docs.select(*carry, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.col(text_col).alias("_text"), draw.alias("_draw"), *([] if weight is None else [weight.alias("_weight")]))
    weight = quality_weight(F.col("_text"), F.col("size")) if weight is None else F.greatest(F.lit(LEAST), F.coalesce("_weight", F.lit(LEAST)))
    base = base.select(*carry, "doc_id", "source", "size", (-F.ln((F.col("_draw") + 0.5) / float(1 << 52)) / weight).alias("key"))
    base = settle(base.withColumn("bucket", bucket_of(F.col("key"))))
    targets = settle(source_targets(base, weights, cap))
    rows = base.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).drop("source")

    # Two levels, so that no task adds up more than the buckets of a coarse one, or the coarse ones of a source.
    def earlier(column: str, order) -> Column:
        return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = rows.groupBy("sid", F.floor(F.col("bucket") / COARSE).alias("coarse"), "bucket").agg(F.sum("size").alias("inside"))
    coarse = sums.groupBy("sid", "coarse").agg(F.sum("inside").alias("all")).select("sid", "coarse", earlier("all", Window.partitionBy("sid").orderBy("coarse")).alias("start"))
    sums = sums.join(coarse, ["sid", "coarse"]).select("sid", "bucket", (F.col("start") + earlier("inside", Window.partitionBy("sid", "coarse").orderBy("bucket"))).alias("before"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["sid", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("epochs", epochs)
    more = F.when((rest > 0) & (F.col("upto") - F.col("size") / 2 <= rest), 1).otherwise(0)
    return rows.withColumn("copies", (F.col("epochs") + more).cast("long")).select(*carry, "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) /
      greatest(0.05::DOUBLE, least(1.0::DOUBLE, len(regexp_extract_all(coalesce(text, ''), '\p{L}+')) / greatest(size, 1)::DOUBLE)
        * greatest(0.0::DOUBLE, 1.0::DOUBLE - (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', ''))) / greatest(size, 1)::DOUBLE)) AS key
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::BIGINT AS most, sum(source_size) OVER ()::BIGINT AS total FROM t),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / sum(w) OVER (ORDER BY most / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
g AS (SELECT *, coalesce(max(CASE WHEN most / w > lvl THEN lvl END) OVER (), 0.0) AS lambda_ FROM l),
a AS (SELECT source, source_size, least(most::DOUBLE, lambda_ * w) AS target, CASE WHEN source_size > 0 THEN floor(least(most::DOUBLE, lambda_ * w) / source_size) ELSE 0 END AS epochs FROM g),
r AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.epochs, a.target - a.epochs * a.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
c AS (SELECT *, (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM c
"""
