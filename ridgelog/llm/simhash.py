"""Near-duplicate groups by SimHash fingerprints and BK-trees."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.llm.bktree import least_linked
from ridgelog.llm.common import by_runs, fresh, row_keys
from ridgelog.llm.components import components
from ridgelog.session import checkpointed

#: fingerprints link at so many differing bits or fewer; the exact way for large buckets rests on 2
RADIUS = 2
#: words of a shingle
SHINGLE = 3
#: bits of the three blocks: two fingerprints that differ in two bits agree in a block
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: a bucket of more fingerprints is split by single flipped bits instead of going into a tree whole
BUCKET_MOST = 512
#: fingerprints of a shard's tree, about
SHARD_ROWS = 2048
_HASHES = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The SimHash of the word shingles of a UTF-8 text; 0 for a text without words or null."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), 42)
    shingles = zip(words, words[1:], words[2:])
    ones, n, join = np.zeros(64, np.int64), len(words) - SHINGLE + 1, b" ".join
    for start in range(0, n, _HASHES):
        most = min(_HASHES, n - start)
        hashes = np.fromiter((digest(join(s), 42) for _, s in zip(range(most), shingles)), np.uint64, most)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        prints = np.fromiter(map(fingerprint, by_runs(batch.column(2).cast(pa.binary()))), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "text_key", "bits"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, bits)``: the fingerprint of every row's whole text as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_keys(doc_id, text)[1].alias("text_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, bits long")


def _tree_links(shard: pd.DataFrame) -> pd.DataFrame:
    values = np.unique(shard["bits"].to_numpy())
    label = least_linked(values.view(np.uint64), RADIUS)
    moved = label != np.arange(len(label))
    return pd.DataFrame({"u": values[moved], "v": values[label[moved]]})


def links(prints: DataFrame, n_prints: int, bucket_most: int = BUCKET_MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``bits`` that tie all within RADIUS bits together.

    Every fingerprint goes to the buckets of its three blocks; a bucket with a
    single fingerprint has no link. Buckets are dealt to shards of about
    ``shard_rows`` fingerprints, whose BK-tree is queried with the shard's own
    fingerprints; a shard returns a spanning forest, never all pairs. A bucket of
    more than ``bucket_most`` fingerprints doesn't go to a tree: each of its
    fingerprints is sent under itself and its 64 single flips. Two fingerprints share
    such a key exactly if they differ in at most 2 bits, and a key has at most
    65 of them, so hot buckets are split without a loss.
    """
    bits = F.col("bits")
    keys = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(bits, at).bitwiseAND((1 << wide) - 1).alias("value")) for k, (at, wide) in enumerate(BLOCKS)])
    keyed = prints.select("bits", F.inline(keys))
    buckets = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = checkpointed(keyed.join(buckets, ["block", "value"]), "simhash-buckets")
    shards = max(1, math.ceil(len(BLOCKS) * n_prints / shard_rows))
    shard = F.pmod(F.xxhash64("block", "value"), F.lit(shards)).alias("shard")
    trees = keyed.where(F.col("n") <= bucket_most).select(shard, "bits").groupBy("shard").applyInPandas(_tree_links, "u long, v long")

    hot = keyed.where(F.col("n") > bucket_most).select("bits").distinct()
    around = F.concat(F.array(bits), *[F.array(*[bits.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])])
    balls = hot.select("bits", F.explode(around).alias("centre")).groupBy("centre").agg(F.collect_set("bits").alias("members"))
    ball = balls.where(F.size("members") > 1).select(F.explode("members").alias("u"), F.array_min("members").alias("v"))
    return trees.union(ball.where("u != v"))


def _grouped(docs: DataFrame, doc_id: str, text: str, bucket_most: int, shard_rows: int) -> DataFrame:
    """``(doc_id, text_key, bits, root, component_id)`` for every row."""
    marked = checkpointed(fingerprints(docs, doc_id, text), "simhash-prints")
    first = checkpointed(marked.groupBy("bits").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    roots = components(links(first.select("bits"), first.count(), bucket_most, shard_rows), "simhash-links")
    named = first.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "first_doc", F.coalesce("root", "bits").alias("root"))
    whole = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return marked.join(named.join(whole, "root").select("bits", "root", "component_id"), "bits")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_most: int = BUCKET_MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    A component holds the rows that are tied together by fingerprints of at most 2
    differing bits; its id is its smallest doc_id. Null and empty texts have the
    fingerprint zero and are linked like any other; rows with a null doc_id take part
    and never name a component unless it holds nothing else (then the id is null).
    Repeated rows stay. Only the two named columns are read. An empty table
    gives no rows.
    """
    groups = _grouped(docs, doc_id, text, bucket_most, shard_rows)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each component stays.

    It is the row with the smallest doc_id. Of repeated rows one stays, and if that
    doc_id stands for several texts of the component, or the component has no
    doc_id at all, the row with the smallest hash of the text.
    """
    groups = _grouped(docs, doc_id, text, BUCKET_MOST, SHARD_ROWS).where("doc_id <=> component_id")
    id_key, text_key = (fresh(docs.columns, n) for n in ("_id_key", "_text_key"))
    kept = groups.groupBy("root").agg(F.coalesce(F.first("doc_id"), F.lit(0)).alias(id_key), F.min("text_key").alias(text_key))
    by_id, by_text = row_keys(doc_id, text)
    rows = docs.withColumns({id_key: by_id, text_key: by_text}).join(kept.drop("root"), [id_key, text_key], "left_semi")
    return rows.dropDuplicates([id_key, text_key]).select(*docs.columns)
