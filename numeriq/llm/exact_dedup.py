"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the largest doc_id
stays. A null doc_id counts as smallest, and is kept only where no other row has the text; rows that repeat a doc_id with the same
text are one document and share its fate. Empty tables give no rows; other columns are ignored.

1. Each row gets a 64-bit key and a SHA-256 of its normalised bytes (fingerprints, a small table in the shared folder).
2. The directory over the keys: it doubles while some bucket holds more than `capacity` keys, and only such buckets split, down to single keys.
   A bucket is a range of keys. Only counts of ranges come to the driver, as many as the directory has entries.
3. Owner tasks take whole buckets, in order of key. Texts of keys that occur more than once come with their bytes, those of a task combined
   before (a text with a third of all rows is one row per task); an owner compares them byte by byte with the entry before, which sorting
   makes the only one that can be equal, and chains entries of one key that differ. The entries are the index, a table in the shared folder.
4. Fingerprints probe the index by bucket, key and digest; what they find is their group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, materialize, raw_digest, table, without

#: Keys beyond this number are joined by a shuffle; up to it they are broadcast, at 8 bytes each.
BROADCAST_KEYS = 1_000_000


def sha_key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def normalised(docs: DataFrame, key: Callable[[bytes], int], with_bytes: bool) -> DataFrame:
    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        b = part = low = keys = last = None
        for b in batches:
            step = 512
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                low = [(x or "").encode("utf-8", "surrogatepass").lower() for x in part.column(1).to_pylist()]
                keys = pa.array([key(x) for x in low], pa.int64())
                last = pa.array(low if with_bytes else [hashlib.sha256(x).digest() for x in low], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), keys, last], names=["doc_id", "raw", "key", "norm" if with_bytes else "sha"])
        del b, part, low, keys, last
        give_back()

    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), raw_digest().alias("raw"))
    return rows.mapInArrow(mapped, f"doc_id long, raw long, key long, {'norm' if with_bytes else 'sha'} binary")


def directory(counts_below: Callable[[int, list[int]], dict[int, int]], capacity: int, step: int = 8, bits: int = 64) -> list[int]:
    """The first key (unsigned) of each bucket. counts_below(depth, prefixes): the number of keys by prefix of depth + step bits, below the given prefixes of depth bits."""
    done: list[int] = []
    over, depth = [0], 0
    while over and depth < bits:
        counts = counts_below(depth, over)
        for d in range(depth, depth + step + 1):
            held = dict.fromkeys(over, 0)
            for prefix, n in counts.items():
                at = prefix >> (depth + step - d)
                if at in held:
                    held[at] += n
            full = {p for p, n in held.items() if n > capacity and d < bits}
            done += [p << (bits - d) for p in held if p not in full]
            over = sorted(full) if d == depth + step else [q for p in sorted(full) for q in (2 * p, 2 * p + 1)]
        depth += step
    return sorted(done)


def key_counts(keys: DataFrame) -> Callable[[int, list[int]], dict[int, int]]:
    """counts_below of a table of distinct keys."""

    def below(depth: int, prefixes: list[int]) -> dict[int, int]:
        some = keys.select("key")
        if depth:
            some = some.withColumn("p", F.shiftrightunsigned("key", 64 - depth))
            some = some.join(F.broadcast(keys.sparkSession.createDataFrame([(p,) for p in prefixes], "p long")), "p", "left_semi")
        return {r["p"]: r["n"] for r in some.groupBy(F.shiftrightunsigned("key", 56 - depth).alias("p")).agg(F.count("*").alias("n")).collect()}

    return below


def in_buckets(df: DataFrame, firsts: list[int]) -> DataFrame:
    """df, of which the first column is the key, with its bucket. The directory is broadcast, at 8 bytes for `capacity` keys or so."""
    import numpy as np

    held = df.sparkSession.sparkContext.broadcast(np.array(firsts, np.uint64))

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(held.value, key, "right") - 1, pa.int64())], names=[*b.schema.names, "bucket"])

    return df.mapInArrow(mapped, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", bucket long")


def combined(texts: DataFrame, firsts: list[int], most_bytes: int = 64 << 20) -> DataFrame:
    """(key, norm, keep_id, n, bucket) of texts (doc_id, raw, key, norm), equal ones of a task made one row as far as its memory goes.

    The bucket is found here, as in_buckets does, for a task has as many Python workers as its steps in Python.
    """
    import numpy as np

    directory_ = texts.sparkSession.sparkContext.broadcast(np.array(firsts, np.uint64))

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        size = 0

        def batch():
            keys = np.array([k for k, _ in held], np.int64)
            bucket = np.searchsorted(directory_.value, keys.view(np.uint64), "right") - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([t for _, t in held], pa.binary()), pa.array([i for i, _ in held.values()], pa.int64()), pa.array([n for _, n in held.values()], pa.int64()), pa.array(bucket, pa.int64())],
                names=["key", "norm", "keep_id", "n", "bucket"],
            )

        for b in batches:
            for doc, key, norm in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "key", "norm"))):
                at = key, norm
                if at in held:
                    i, n = held[at]
                    held[at] = (doc if i is None else i if doc is None else max(i, doc)), n + 1
                else:
                    held[at] = doc, 1
                    size += len(norm)
            if size > most_bytes:
                yield batch()
                held, size = {}, 0
        yield batch()
        held = {}
        give_back()

    return texts.mapInArrow(mapped, "key long, norm binary, keep_id long, n long, bucket long")


def chained(owned: DataFrame) -> DataFrame:
    """Index entries from rows (bucket, key, norm, sha, keep_id, n) in that order; norm is null for a key that occurs once."""

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["bucket", "key", "chain", "sha", "keep_id", "group_size"]
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()
        now, out = None, []

        def close():
            bucket, key, chain, norm, sha, keep, n = now
            out.append((bucket, key, chain, sha if norm is None else hashlib.sha256(norm).digest(), keep, n))

        for b in batches:
            for bucket, key, norm, sha, keep, n in zip(*(c.to_pylist() for c in b.columns)):
                same_key = now is not None and now[:2] == [bucket, key]
                if same_key and now[3] == norm:
                    now[5] = keep if now[5] is None else now[5] if keep is None else max(now[5], keep)
                    now[6] += n
                    continue
                if now is not None:
                    close()
                now = [bucket, key, now[2] + 1 if same_key else 1, norm, sha, keep, n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                out = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return owned.mapInArrow(mapped, "bucket long, key long, chain long, sha binary, keep_id long, group_size long")


def build_index(docs: DataFrame, capacity: int = 4096, key: Callable[[bytes], int] = sha_key) -> tuple[DataFrame, DataFrame, list[int]]:
    """(fingerprints, index, directory). fingerprints: doc_id, raw, key, sha. index: bucket, key, chain, sha, keep_id, group_size."""
    prints = materialize(normalised(docs, key, False), "dedup-fingerprints")
    by_key = materialize(prints.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.min("sha").alias("sha")), "dedup-keys")
    firsts = directory(key_counts(by_key), capacity)
    shared = by_key.filter("n > 1").select("key")
    wanted = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    texts = combined(normalised(docs, key, True).join(wanted, "key", "left_semi").select("doc_id", "raw", "key", "norm"), firsts)
    texts = texts.withColumn("sha", F.lit(None).cast("binary"))
    alone = by_key.filter("n = 1").select("key", F.lit(None).cast("binary").alias("norm"), "sha", "keep_id", "n")
    columns = ["bucket", "key", "norm", "sha", "keep_id", "n"]
    owned = texts.select(*columns).unionByName(in_buckets(alone, firsts).select(*columns)).repartition("bucket").sortWithinPartitions("bucket", "key", "norm")
    return prints, materialize(chained(owned), "dedup-index"), firsts


def placed(docs: DataFrame, **options) -> DataFrame:
    prints, index, firsts = build_index(docs, **options)
    probes = in_buckets(prints.select("key", "sha", "doc_id", "raw"), firsts)
    found = probes.join(index.select("bucket", "key", "sha", "keep_id", "group_size"), ["bucket", "key", "sha"])
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return placed(docs, **options).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs that stay, with the columns of docs."""
    return without(docs, placed(docs, **options).filter("NOT kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
