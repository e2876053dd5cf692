"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids with an end id; longer ones are cut into pieces of the full length, of which the first may be shorter.
How many pieces there are of each length (as many numbers as a sequence has tokens) is all that the driver plans with:

1. For each length, from the longest, combinations that fill the gap exactly are consumed: one piece, else a pair, else a triple,
   found in an index of the length sums that are still available, as often as availability allows.
2. What is left is packed by best fit: the longest piece first, then always the longest that fits.

The plan is a list of intervals: pieces number lo to hi of a length go to sequences first, first+1, ... at a given offset. Pieces
are numbered by distributed counts and joined to the plan.

Nulls: a null text counts as empty and gives one piece, the end id; a null doc_id is kept. Repeated rows are packed each. A text of any
length is encoded whole and cut into as many pieces as it needs. Of pieces of one length any may take any of the places planned for
that length: they are alike to the packing. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, id_and_text, id_back, materialize, table

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def added_tokens(spec: str) -> list[str]:
    """The texts of a vocabulary file's added tokens, without reading its model."""
    import json

    return [t["content"] for t in json.JSONDecoder().raw_decode(spec, spec.index("[", spec.index('"added_tokens"')))[0]]


def byte_bpe(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as the tokenizers library gives them for json_path; ranks_path holds the same vocabulary as ranks, which tiktoken
    encodes several times faster. Texts that it refuses go to the tokenizers library, which is loaded with the first of them: each worker
    would hold a second vocabulary otherwise."""
    import base64
    import functools

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        marks = added_tokens(f.read())
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cache
    def exact():
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(json_path)
        whole.no_padding()
        whole.no_truncation()
        return whole

    def encode(text: str) -> list[int]:
        if any(m in text for m in marks):
            return exact().encode(text, add_special_tokens=False).ids
        try:
            return quick.encode_ordinary(text)
        except BaseException as e:  # the Rust side panics on texts that overrun its regex engine
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return exact().encode(text, add_special_tokens=False).ids

    return encode


def cut_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import public_tokenizers as P

        encode = byte_bpe(P.path(f"{vocabulary}.json"), P.path(f"{vocabulary}.tiktoken"), P.PATTERN)
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"].array, pdf["text"].array):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                a, z = 0, (len(ids) - 1) % size + 1
                piece = 0
                while a < len(ids):
                    out.append((doc, piece, a, z - a, zlib.crc32(ids[a:z].tobytes())))
                    a, z, piece = z, z + size, piece + 1
            yield pd.DataFrame(out, columns=columns)
        del encode
        give_back()

    return id_back(id_and_text(docs).mapInPandas(mapped, PIECES))


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first, per, offset): pieces lo <= n < hi of a length go to sequence first + (n - lo) // per, at
    offset + (n - lo) % per * length. Each step uses up a length, so there are few steps however many pieces there are."""
    import numpy as np

    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(size + 1, np.int64)
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def times(lengths: list[int]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in set(lengths))

    def take(lengths: list[int], k: int) -> None:
        nonlocal sequences
        offset = 0
        for x in dict.fromkeys(lengths):
            per = lengths.count(x)
            lo = int(used[x])
            plan.append((x, lo, lo + per * k, sequences, per, offset))
            used[x] += per * k
            left[x] -= per * k
            offset += per * x
        sequences += k

    def pair(total: int, base: list[int]) -> list[int] | None:
        """Two available lengths of this sum, as equal as can be left to the last: the longest first."""
        a = np.arange((total + 1) // 2, total)[::-1]
        for x in a[(left[a] > 0) & (left[total - a] > 0)]:
            found = [int(x), total - int(x)]
            if times(base + found):
                return found
        return None

    for length in range(size, 0, -1):
        gap = size - length
        if gap == 0 and left[length]:
            take([length], int(left[length]))
        while left[length] and gap and left[gap] and (k := times([length, gap])):
            take([length, gap], k)
        while left[length] and gap > 1 and (found := pair(gap, [length])):
            take([length, *found], times([length, *found]))
        while left[length] and gap > 2:
            sums = np.convolve(left[:gap] > 0, left[:gap] > 0)[:gap] > 0  # index of available pair sums
            third = np.flatnonzero((left[1:gap] > 0) & sums[gap - 1 : 0 : -1]) + 1
            for x in third[::-1]:
                if left[length] and (found := pair(gap - int(x), [length, int(x)])):
                    take([length, int(x), *found], times([length, int(x), *found]))
                    break
            else:
                break
    for length in range(size, 0, -1):
        while left[length]:
            lengths, gap, free = [length], size - length, left.copy()
            free[length] -= 1
            while gap:
                fits = np.flatnonzero(free[: gap + 1])
                if not len(fits):
                    break
                x = int(fits[-1])
                n = min(gap // x, int(free[x]))
                lengths += [x] * n
                free[x] -= n
                gap -= n * x
            take(lengths, times(lengths))
    return plan


def pack(pieces: DataFrame, size: int = 1024, rows_per_salt: int = 2000) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read several times and should be a table."""
    spark = pieces.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    plan = spark.createDataFrame(plan_packing(hist, size), "length long, lo long, hi long, first long, per long, at long")
    salts = max(1, -(-max(hist.values(), default=0) // rows_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("before", before).drop("n")
    numbered = salted.withColumn("number", within - 1).join(starts, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    # The plan has some intervals for each of `size` lengths, whatever the number of pieces.
    placed = numbered.alias("p").join(F.broadcast(plan.alias("q")), (F.col("p.length") == F.col("q.length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    place = F.col("number") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first") + F.floor(place / F.col("per"))).alias("sequence_id"), (F.col("at") + place % F.col("per") * F.col("p.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    return pack(materialize(cut_pieces(docs, size, end_id, vocabulary), "pieces"), size)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
