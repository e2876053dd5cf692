"""Document fingerprints by locally consistent parsing.

A text's code points are symbols. A level cuts runs of one symbol every four symbols, and what is between runs by deterministic coin tossing: the lowest
bit in which a symbol differs from the one before, and its value there, four times, which brings 32-bit symbols down to six colours; three passes leave
three, and local maxima begin phrases, of 2 to 4 symbols. A phrase's name is a hash of its symbols; names are the symbols of the next level. A cut depends
on a few symbols around it or on the place in a run, so equal substrings have equal names inside wherever they stand.

A fingerprint holds, for a text's top level and the one below, the smallest hashes of the names (repeats count apart). The top level is the highest (3 at most, phrases
of about 16 code points) that has at least FEW phrases. `likeness` estimates the share of names at the highest level that both have, 2 |A & B| / (|A| + |B|),
from the smallest hashes of their union (exact where texts have no more names than that); it is 1 for equal fingerprints and 0 without a common level, when
one text is several times as long as the other.
The edited text of a document has its last floor(n / 2) code points replaced by the first as many of the next document, descending doc_id, null last, the
first after the last; of equal doc_ids the larger 64-bit hash of the text comes first, and rows that repeat both follow each other. Documents are dealt
in ranges of that order; the first of each range goes to the range before too, so texts are shuffled once. Nulls count as empty; empty texts have the
fingerprint "" and are like each other; a table of one row follows itself; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, table

#: Least phrases of a level that is a top level, and the highest of these.
FEW, TOP = 16, 3
#: Hashes kept of the top level and of the one below.
KEPT = 64, 32
#: Bytes of text in a range of documents; code points that are parsed at once (a longer text is parsed on its own).
RANGE_BYTES, AT_ONCE = 8 << 20, 1 << 20
#: Ranges at most, and keys sampled for each to place its bound.
MOST_RANGES, SAMPLED = 100_000, 30


def mixed(x):
    """Hashes of 32-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def tossed(x, first):
    """2 b + the bit b of each number, b being the lowest bit in which it differs from the one before; the first of a text differs in bit 0."""
    import numpy as np

    one = x.dtype.type(1)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = x[first] ^ one
    before ^= x
    low = before & (~before + one)
    return (np.bitwise_count(low - one) << np.uint8(1)) | ((x & low) != 0).view(np.uint8)


def colours(symbols, first):
    """Colours 0, 1 or 2 of symbols, of which neighbours differ; no two neighbours get the same. first: where texts start."""
    import numpy as np

    label = symbols
    for _ in range(4):
        label = tossed(label, first)
    # What neighbours leave free: bits of their colours; a text's ends have a neighbour on one side only.
    for colour in (5, 4, 3):
        taken = np.uint8(1) << label
        left, right = np.zeros_like(taken), np.zeros_like(taken)
        left[1:], right[:-1] = taken[:-1], taken[1:]
        left[first] = 0
        right[first[1:] - 1] = 0
        free = ~(left | right)
        least = np.where(free & np.uint8(1), np.uint8(0), np.where(free & np.uint8(2), np.uint8(1), np.uint8(2)))
        label = np.where(label == colour, least, label)
    return label


def parsed(symbols, text, level: int):
    """(names, text): phrases of the symbols, in order; text numbers the text of each, ascending."""
    import numpy as np

    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(text[1:], text[:-1], out=new[1:])
    as_before = np.zeros(len(symbols) + 1, bool)
    as_before[1:-1] = (symbols[1:] == symbols[:-1]) & ~new[1:]
    in_run = as_before[:-1] | as_before[1:]
    # Segments: runs, and what is between them.
    segment = new.copy()
    segment[1:] |= ~as_before[1:-1] & (in_run[1:] | in_run[:-1])
    first = np.flatnonzero(segment)
    colour = colours(symbols, first)
    cut = np.zeros(len(symbols), bool)
    cut[1:-1] = (colour[1:-1] > colour[:-2]) & (colour[1:-1] > colour[2:]) & ~segment[2:] & ~in_run[1:-1]
    within = np.flatnonzero(in_run)
    if len(within):
        run = first[np.searchsorted(first, within, "right") - 1]
        cut[within] = (within - run) % 4 == 0
    cut |= segment
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(symbols)))
    place = np.arange(1, len(symbols) + 1, dtype=np.uint32) - np.repeat(at.astype(np.uint32), size)
    names = np.add.reduceat(mixed(symbols + place * np.uint32(0x9E3779B1)), at, dtype=np.uint32)
    return mixed(names + np.uint32(level * 0x165667B1)), text[at]


def smallest(names, text, kept: dict[int, int]) -> dict:
    """By text, the smallest hashes of its names, as many as kept says; the second, third ... occurrence of a name in its text counts as a name of its own."""
    import numpy as np

    wanted = np.zeros(int(text[-1]) + 1 if len(text) else 1, bool)
    wanted[list(kept)] = True
    chosen = wanted[text]
    owner, low = text[chosen].astype(np.uint64) << np.uint64(32), names[chosen]
    keys = np.sort(owner | low)
    begins = np.append(True, keys[1:] != keys[:-1])
    at = np.flatnonzero(begins)
    nth = np.arange(len(keys), dtype=np.uint32) - np.repeat(at.astype(np.uint32), np.diff(np.append(at, len(keys))))
    low = mixed(keys.astype(np.uint32) + nth * np.uint32(0x9E3779B1))
    keys = np.sort((keys & np.uint64(0xFFFFFFFF00000000)) | low)
    low = keys.astype(np.uint32).astype(">u4")
    spans = np.searchsorted(keys >> np.uint64(32), np.array([[i, i + 1] for i in kept], np.uint64))
    return {i: low[a : min(b, a + kept[i])] for i, (a, b) in zip(kept, spans)}


def fingerprints_of(texts: list[str]) -> list[str]:
    """Fingerprints of texts: per level its number, `:` and its hashes in hex, the top level first."""
    import numpy as np

    out: list[str] = [""] * len(texts)
    sizes = [len(t) for t in texts]
    begin = 0
    while begin < len(texts):
        end, total = begin + 1, sizes[begin]
        while end < len(texts) and total + sizes[end] <= AT_ONCE:
            total += sizes[end]
            end += 1
        n = end - begin
        symbols = np.frombuffer("".join(texts[begin:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        levels = [(symbols, np.repeat(np.arange(n, dtype=np.uint32), sizes[begin:end]))]
        while total and len(levels) <= TOP:
            levels.append(parsed(*levels[-1], len(levels)))
        full = np.array([np.bincount(text, minlength=n) >= FEW for _, text in levels])
        top = np.where(full.any(0), len(levels) - 1 - full[::-1].argmax(0), 0)
        held: list[list[str]] = [[] for _ in range(n)]
        for l in range(len(levels) - 1, -1, -1):
            kept = {i: KEPT[top[i] - l] for i in np.flatnonzero((top == l) | (top == l + 1)).tolist() if sizes[begin + i]}
            if kept:
                for i, hashes in smallest(*levels[l], kept).items():
                    held[i].append(f"{l}:{hashes.tobytes().hex()}")
        out[begin:end] = map(",".join, held)
        begin = end
    return out


def likeness(a: str, b: str) -> float:
    """Estimated share of two texts' phrases that are common, from their fingerprints: 0 to 1."""
    import numpy as np

    if a == b:
        return 1.0
    left, right = (dict(p.split(":") for p in x.split(",") if p) for x in (a, b))
    common = sorted(left.keys() & right.keys())
    if not common:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(side[common[-1]]), ">u4") for side in (left, right))
    kept = min(KEPT[0] if common[-1] == max(left) else KEPT[1], KEPT[0] if common[-1] == max(right) else KEPT[1])
    union = np.union1d(x, y)[:kept]
    share = np.isin(union, np.intersect1d(x, y)).mean()
    return float(2 * share / (1 + share))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id (null as the least), hash, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return lean(docs).select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def in_order(docs: DataFrame) -> DataFrame:
    """range, id, hash, copies, doc_id, text of every document once, and of the one that follows a range once more, with 0 copies, in that range."""
    spark, rows = docs.sparkSession, keyed(docs)
    keys = materialize(rows.select("id", "hash", F.octet_length("text").alias("bytes")), "fingerprint-keys")
    count, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(4 * spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)))
    some = sorted((r["id"], r["hash"]) for r in keys.select("id", "hash").sample(min(1.0, SAMPLED * ranges / max(1, count)), seed=1).collect())
    bounds = sorted(set(some[:: max(1, len(some) // ranges)]))

    again = materialize(keys.groupBy("id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("id", "hash"), "fingerprint-repeats")
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if not again.isEmpty():
        repeated = rows.join(again, ["id", "hash"], "left_semi").groupBy("doc_id", "id", "hash", "text").agg(F.count("*").alias("copies"))
        rows = rows.join(again, ["id", "hash"], "left_anti").select("doc_id", "id", "hash", "text", "copies").unionByName(repeated)

    def numbered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = pa.array([bisect.bisect_right(bounds, k) for k in zip(b["id"].to_pylist(), b["hash"].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([at, *b.columns], names=["range", *b.schema.names])

    firsts = keys.select("id", "hash").mapInArrow(numbered, "range long, id long, hash long").groupBy("range").agg(F.max(F.struct("id", "hash")).alias("f")).select("range", "f.*").collect()
    # Descending, a range is followed by the one below it that holds documents, the lowest by the highest.
    held = sorted((r["range"], (r["id"], r["hash"])) for r in firsts)
    follows = {key: held[(i + 1) % len(held)][0] for i, (_, key) in enumerate(held)}

    def dealt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in next_batches(batches):
            yield b
            more = [(i, follows[k]) for i, k in enumerate(zip(b["id"].to_pylist(), b["hash"].to_pylist())) if k in follows]
            if more:
                t = b.take(pa.array([i for i, _ in more]))
                yield pa.RecordBatch.from_arrays([pa.array([r for _, r in more], pa.int64()), pa.array([0] * len(more), pa.int64()), *t.columns[2:]], names=t.schema.names)

    def next_batches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in numbered(batches):
            yield pa.RecordBatch.from_arrays([b[c] for c in ("range", "copies", "id", "hash", "doc_id", "text")], names=["range", "copies", "id", "hash", "doc_id", "text"])

    tasks = max(min(ranges, 2 * spark.sparkContext.defaultParallelism), ranges // 4)
    put = rows.select("id", "hash", "copies", "doc_id", "text").mapInArrow(dealt, "range long, copies long, id long, hash long, doc_id long, text string")
    last = F.col("copies") == 0
    return put.repartition(tasks, "range").sortWithinPartitions("range", last, F.col("id").desc(), F.col("hash").desc())


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""

    def judged(pairs: list) -> Iterator:
        """pairs: (doc_id, copies, text, next text)."""
        import pyarrow as pa

        rows = []
        for doc_id, copies, text, after in pairs:
            rows += [(doc_id, text, text)] * (copies > 1) + [(doc_id, text, after)]
        half = [len(t) // 2 for _, t, _ in rows]
        edited = [t[: len(t) - h] + a[:h] for (_, t, a), h in zip(rows, half)]
        every = list(dict.fromkeys([t for _, t, _ in rows] + [a for _, _, a in rows] + edited))
        mark = dict(zip(every, fingerprints_of(every)))
        repeats = iter([c for _, n, _, _ in pairs for c in ([n - 1, 1] if n > 1 else [1])])
        out = [(d, next(repeats), len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), mark[t], mark[e], likeness(mark[t], mark[e]), likeness(mark[t], mark[a])) for (d, t, a), e in zip(rows, edited)]
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "copies", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def mapped(batches: Iterator) -> Iterator:
        pairs, size, held = [], 0, None
        for b in batches:
            for range_, copies, doc_id, text in zip(*(b[c].to_pylist() for c in ("range", "copies", "doc_id", "text"))):
                if held is not None and held[0] == range_:
                    pairs.append((*held[1:], text))
                    size += 2 * len(held[3]) + len(text)
                    if size > AT_ONCE:
                        yield from judged(pairs)
                        pairs, size = [], 0
                held = None if copies == 0 else (range_, doc_id, copies, text)
        if pairs:
            yield from judged(pairs)

    found = in_order(docs).mapInArrow(mapped, "doc_id long, copies long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
