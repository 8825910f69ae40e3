"""Mixing sources to target weights by prefix sums over hash-random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import WORD, documents, query, row_key, steady, version

_BLOCK_DIGITS = 3  # hexadecimal digits of the key that name a block: 4096 blocks per source


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. No target exceeds ``most`` times its source; what is above is shared again by
    weight. That is one water level: with sources by the ratio of their cap to their weight,
    the first whose share of the rest stays below its cap sets it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1)
    weighed = sources.select("*", turn.cast("bigint").alias("w"), (F.col("source_size") * most).alias("cap"))
    line = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    levels = weighed.select("source", "source_size", "w", "cap", ((total - before).cast("double") / rest).alias("level"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))
    level = F.coalesce(F.min(fits).over(Window.partitionBy())["level"], F.lit(0.0))
    return levels.select("source", "source_size", F.least(level * F.col("w"), F.col("cap").cast("double")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs, taken, version (a hash
    of the text).

    Size is the number of words, 0 for null. Each document gets a random key by hashing its
    id, so reruns agree. A source is taken whole as often as its target holds it, and the
    rest is the start of the order by key, cut where the sum comes nearest to the budget:
    the sum misses it by half a document at most. The order is never sorted in one task: the
    first digits of the key cut a source into 4096 even blocks, sums run inside blocks, and
    one row per block carries them across.

    Rows of one id are ordered by size, so repeated rows get a defined result together. A
    null id hashes like empty text. Words of 0 are taken from empty texts. The table of
    sources is one row per source. An empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = steady(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"), key.alias("key"), version(text_col).alias("version"),
    ).withColumn("block", F.substring("key", 1, _BLOCK_DIGITS)))

    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("in_block"))
    budget = targets(blocks.groupBy("source").agg(F.sum("in_block").alias("source_size")), weights, most)
    across = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("source", "block", F.coalesce(F.sum("in_block").over(across), F.lit(0)).alias("carry"))
    plan = carried.alias("c").join(budget.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source"))).select(
        F.col("c.source").alias("s"), F.col("c.block").alias("b"), "carry", "source_size", "target"
    )

    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(inside))
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sized = joined.withColumn("whole", whole.cast("bigint"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    middle = F.col("carry") + F.col("upto") - F.col("size") / 2
    return sized.withColumn("epochs", F.col("whole") + F.when((F.col("size") > 0) & (middle <= left), 1).otherwise(0)).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), "version"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: all columns of the documents taken, each as often as it has epochs.
    Texts that share an id or have none each have their own epochs; rows that repeat an id,
    text and source share out the epochs planned for them, the first by their hash one more."""
    id_col, text_col, source_col = (options.get(c, d) for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    keys = ["key", "version", "origin"]
    planned = mix(docs, **options).groupBy(row_key("doc_id").alias("key"), "version", row_key("source").alias("origin"))
    times = planned.agg(F.sum("epochs").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 0")
    row = F.struct(*docs.columns)
    keyed = docs.select(row.alias("row"), row_key(id_col).alias("key"), version(text_col).alias("version"), row_key(source_col).alias("origin"), F.xxhash64(row).alias("hash"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    own = F.floor(F.col("times") / F.col("rows")) + F.when(nth <= F.col("times") % F.col("rows"), 1).otherwise(0)
    taken = keyed.join(times, keys).withColumn("own", own.cast("int")).where("own > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")


@query(
    "op9_mix_sources",
    r"""
    with rows as (
        select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
               md5('mix:' || coalesce(doc_id::varchar, '')) as key
        from documents
    ), sources as (
        select source, sum(size)::bigint as source_size from rows group by source
    ), weighed as (
        select *, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as w,
               source_size * 3 as cap
        from sources
    ), levels as (
        select *, (sum(source_size) over () - coalesce(sum(cap) over (
                   order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
               / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following)::double as level
        from weighed
    ), found as (
        select coalesce(min_by(level, cap / w), 0) as level from levels where level * w <= cap
    ), budget as (
        select source, source_size, least((select level from found) * w, cap::double) as target from levels
    ), placed as (
        select r.*, b.source_size, b.target,
               case when b.source_size > 0 then floor(b.target / b.source_size)::bigint else 0 end as whole,
               sum(size) over (partition by r.source order by key, doc_id, size rows unbounded preceding) as upto
        from rows r join budget b on r.source is not distinct from b.source
    )
    select doc_id, size, source_size, target,
           (size * (whole + case when size > 0 and upto - size / 2 <= target - whole * source_size then 1 else 0 end))::bigint as taken
    from placed
    """,
)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
