"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import sys
from itertools import combinations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.common import documents, query, row_key, steady, text_key
from docflow.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BITS = 64


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


_ONE = [_signed(1 << i) for i in range(_BITS)]
_BLOCKS = [range(64 * i // 6, 64 * (i + 1) // 6) for i in range(6)]
_THREE_BLOCKS = [_signed(sum(1 << bit for block in some for bit in block)) for some in combinations(_BLOCKS, 3)]
_HALVES = (range(_BITS // 2), range(_BITS // 2, _BITS))
_TWO = [_signed(1 << i | 1 << j) for half in _HALVES for i, j in combinations(half, 2)]


def simhash(text: str | None, width: int = 3, seed: int = 42, step: int = 65536) -> int:
    """64-bit SimHash of a text over shingles of words, as a signed number. A bit is set if
    it is set in over half of the shingles' hashes. No word gives 0."""
    import numpy as np
    import xxhash

    # bytes.lower() touches A-Z only, and bytes.split() cuts at \x20 and \x09-\x0D.
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    total = max(1, len(tokens) - width + 1)
    ones = np.zeros(_BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, step):
        stop = min(total, start + step)
        hashes = np.array([digest(b" ".join(tokens[i : i + width]), seed) for i in range(start, stop)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(ones * 2 > total, bitorder="little")
    return int(chosen.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` per document, texts read batch by batch."""
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            prints = pa.array([simhash(t.as_py(), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, fp bigint")


def with_partner(prints: DataFrame) -> DataFrame:
    """Those of distinct fingerprints ``fp`` that may have another one at 3 or fewer bits.

    Three differing bits leave at least three of six blocks of bits equal, so a fingerprint
    that shares no three blocks with any other is alone and needs no ball. Each is looked up
    under the 20 choices of blocks; a key is counted before its members meet the counts, so
    thousands of fingerprints under one key are no single task's work.
    """
    blocks = prints.select("fp", F.posexplode(F.lit(_THREE_BLOCKS)).alias("n", "mask"))
    keys = blocks.select("fp", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "n").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    return keys.join(shared, "key", "left_semi").select("fp").distinct()


def ball_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that connect all pairs at 3 or
    fewer differing bits, and no others.

    Half of three is one bit on one side and two on the other; which side flips two is
    settled by parity. Odd fingerprints emit their 64 neighbours. Even ones emit
    themselves, their 64 neighbours, and of the pairs of flips those inside one half of the
    word: of three differing bits two lie in one half, so the flips of the even side meet
    the one flip of the odd side. All variants are full 64-bit keys.

    At an even variant odd members differ from it in one bit and even ones in none or two,
    so every member is within 3 of every odd one: all are linked to the least odd member.
    At an odd variant all members differ in one bit, so they are within 2 of each other and
    are linked to the least. Collisions thus are verified by where they meet; a variant has
    at most 1,057 members, and gives one link per member, never all pairs.
    """
    odd = lambda c: F.bit_count(c) % 2 == 1
    flips = F.when(odd(F.col("fp")), F.lit(_ONE)).otherwise(F.lit([0, *_ONE, *_TWO]))
    balls = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    middle = F.when(odd(F.col("fp")) | odd(F.col("v")), F.col("fp"))
    met = balls.select("fp", F.min(middle).over(Window.partitionBy("v")).alias("least"))
    return met.where("least <> fp").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per document: doc_id, fp, component_id.

    Fingerprints at 3 or fewer differing bits are linked; component_id is the smallest id
    reachable, the own one included. Null and empty texts have fingerprint 0, which is
    linked like any other. Null ids are passed over when the smallest is sought; a component
    of null ids only has a null id. Repeated rows come out as often as they come in, an
    empty table gives no rows, further columns of the input are not read.
    """
    prints = steady(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = components(ball_links(with_partner(nodes.select("fp")))).withColumnRenamed("node", "fp")
    placed = nodes.join(grouped, "fp").select("fp", "component", "first")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = placed.join(least, "component").select("fp", "component_id")
    named = nodes.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns. Null ids
    rank last; of texts that share an id the one of the smallest hash counts as first, and of
    rows that repeat an id and its text one stays."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = near_dedup(keyed, "key", "text").where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    # As text and number the parts of the key compare in a join by hash.
    flat = lambda df: df.withColumns({"k": row_key("key.id"), "v": F.col("key.version")}).drop("key", "text")
    return flat(keyed).join(flat(found), ["k", "v"], "left_semi").dropDuplicates(["k", "v"]).select("row.*")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
