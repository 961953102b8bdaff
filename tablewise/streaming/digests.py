"""Which rows were loaded before: digests in a table by prefix, and Bloom filters that keep most look-ups away.

Every batch b writes

* ``digests/batch_id=b/prefix=p``: the SHA-256 of its new rows, dealt by their first bits;
* ``filters/last=b``: one Bloom filter per prefix over the batches that b closes. As in a binary indexed tree these are the
  last ``2**z`` batches, z being the number of zeros that b + 1 ends with in binary, so all batches before any b are
  covered by at most log2(b) + 1 filters, each is written once, and a digest is put into log2(b) filters at most.

A batch's digests go to its prefix's filters; what no filter holds is new, and only the others (repeats, and about one new
digest in 4,000 and filter) are looked up in the digests, in the prefixes that occur among them. Nothing is kept as state
of the stream. A batch that is run again reads what earlier batches wrote and overwrites its own files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.columns import row_digest

BITS_PER_DIGEST, PROBES = 24, 6
_DIGESTS = "digest binary, batch_id int, prefix int"
_FILTERS = "prefix int, bits binary"


def filter_bits(n: int) -> int:
    """Bits of a filter for n digests: a power of two."""
    return 1 << max(10, int(n * BITS_PER_DIGEST - 1).bit_length())


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each digest (rows of four 64-bit words): PROBES steps from one word by another."""
    start, step = digests[:, 0], digests[:, 1] | np.uint64(1)
    return (start[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, 4)


def filled(digests: np.ndarray) -> bytes:
    bits = filter_bits(len(digests))
    cells = np.zeros(bits, bool)
    cells[places(digests, bits).reshape(-1)] = True
    return np.packbits(cells, bitorder="little").tobytes()


def holds(bits: bytes, digests: np.ndarray) -> np.ndarray:
    cells = np.frombuffer(bits, np.uint8)
    at = places(digests, 8 * len(cells))
    return ((cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(1)


def closed_batches(batch_id: int) -> int:
    """How many batches the filters of a batch cover, itself included."""
    return (batch_id + 1) & -(batch_id + 1)


def layers_before(batch_id: int) -> list[int]:
    """The batches whose filters together cover all earlier batches."""
    found, end = [], batch_id
    while end > 0:
        found.append(end - 1)
        end -= closed_batches(end - 1)
    return found


class DigestIndex:
    def __init__(self, spark: SparkSession, root: str, prefix_bits: int = 8):
        self.spark, self.root, self.prefix_bits = spark, root.rstrip("/"), prefix_bits

    def with_digest(self, rows: DataFrame) -> DataFrame:
        """``rows`` with __digest (of all columns) and __prefix."""
        first = F.conv(F.substring(F.hex("__digest"), 1, 4), 16, 10).cast("int")
        return rows.withColumn("__digest", row_digest(rows)).withColumn("__prefix", F.shiftright(first, 16 - self.prefix_bits))

    def suspects(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """digest, prefix of the rows that a filter of an earlier batch holds."""
        layers = layers_before(batch_id)
        if not layers:
            return None
        paths = [f"{self.root}/filters/last={b}" for b in layers]
        filters = self.spark.read.schema(_FILTERS).parquet(*paths)

        kinds = pa.schema([("digest", pa.binary()), ("prefix", pa.int32())])

        def probe(key, new, old):
            if not new.num_rows or not old.num_rows:  # the columns of an empty side are not given
                return kinds.empty_table()
            digests = _words(new.column("digest"))
            hit = np.zeros(len(digests), bool)
            for bits in old.column("bits").to_pylist():
                hit |= holds(bits, digests)
            return new.filter(pa.array(hit))

        new = rows.select(F.col("__digest").alias("digest"), F.col("__prefix").alias("prefix"))
        return new.groupBy("prefix").cogroup(filters.groupBy("prefix")).applyInArrow(probe, "digest binary, prefix int")

    def known(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """digest of the rows that earlier batches loaded."""
        suspects = self.suspects(rows, batch_id)
        if suspects is None:
            return None
        suspects = suspects.distinct().persist()
        prefixes = [r["prefix"] for r in suspects.select("prefix").distinct().collect()]  # 2 ** prefix_bits at most
        if not prefixes:
            suspects.unpersist()
            return None
        stored = self.spark.read.schema(_DIGESTS).parquet(f"{self.root}/digests")
        stored = stored.filter((F.col("batch_id") < batch_id) & F.col("prefix").isin(prefixes))
        return suspects.join(stored.select("digest"), "digest", "left_semi").select("digest")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the digests of a batch's new rows, then the filters that the batch closes."""
        own = rows.select(F.col("__digest").alias("digest"), F.lit(batch_id).alias("batch_id"), F.col("__prefix").alias("prefix"))
        writer = own.repartition("prefix").sortWithinPartitions("prefix", "digest").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "prefix").parquet(f"{self.root}/digests")
        stored = self.spark.read.schema(_DIGESTS).parquet(f"{self.root}/digests")
        stored = stored.filter(F.col("batch_id").between(batch_id + 1 - closed_batches(batch_id), batch_id))

        def build(key, table):
            return pa.table({"prefix": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([filled(_words(table.column("digest")))], pa.binary())})

        filters = stored.select("prefix", "digest").groupBy("prefix").applyInArrow(build, _FILTERS)
        filters.write.mode("overwrite").parquet(f"{self.root}/filters/last={batch_id}")

    def without_known(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Distinct rows that no earlier batch loaded, with __digest and __prefix."""
        rows = self.with_digest(rows).dropDuplicates(["__digest"])
        known = self.known(rows, batch_id)
        return rows if known is None else rows.join(known.withColumnRenamed("digest", "__digest"), "__digest", "left_anti")
