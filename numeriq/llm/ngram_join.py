"""Near duplicates: a Jaccard join of word n-gram sets by chosen paths.

The set of a document holds the hashes of its runs of five words (lower case, cut at white space; a text of fewer words is one run).
Documents with equal sets are one entry. For each of several runs, an entry walks down a tree: at each node it follows the shared tokens
whose hash, seeded by the node, falls below 1 / (threshold * set size), so that two sets of at least that similarity are expected to
share at least one branch at every level. A bucket splits down to `depth` while it holds more than `small` entries, unless nine in ten of
them are alike, since a group of near copies would stay together and only be repeated.

1. Buckets give candidates: every entry with the first of its bucket, if their sketches allow the threshold (4.5 deviations).
   Where that leaves a bucket in more than one connected part, all pairs across the parts are compared by sketch, in blocks.
2. Candidates' connected parts hold every link that was found. In each, all pairs are compared exactly, in blocks of sets, by
   products of 0/1 matrices; this counts links and gives edges within blocks.
3. The exact edges' components are the classes.

Runs follow from the target recall: with q(0) = 1 and q(l + 1) = 1 - exp(-q(l)), a pair at the threshold meets at level l of a run with
probability q(l) at least. Nothing is capped: buckets that stay large after the last split are compared as in step 1.

Result: one row per document: doc_id, class_id (the smallest doc_id of the class), class_size, n_links (other texts of at least this
similarity; copies of one text count once).

Null or blank texts have no n-grams and are classes of their own without links. A null doc_id is kept, and counts in class_size.
Repeated rows are copies. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, id_and_text, id_back, materialize, raw_digest, runs, table, without
from .components import components

BINS = 64
#: Ids beyond this number are joined by a shuffle; up to it they are broadcast, at 8 bytes each.
BROADCAST_IDS = 1_000_000


def mix(x):
    """Scrambles an array of uint64."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = None

    def of(self, n: int):
        import numpy as np

        if self.up is None or len(self.up) < n:
            size = 1 << max(16, n.bit_length())
            up, down = np.full(size, self.BASE, np.uint64), np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


def ngram_sets(texts: list[str], words: int, powers: Powers):
    """(flat, counts): the sorted distinct hashes of each text's word n-grams, one after the other."""
    import numpy as np

    raw = [" ".join(t.lower().split()).encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = (flat == 32) | (flat == 10)
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    doc = np.cumsum(flat == 10)[starts]
    per = np.bincount(doc, minlength=len(texts))
    last = np.repeat(np.cumsum(per) - 1, per)
    place = np.arange(len(starts))
    to = np.minimum(place + words - 1, last)
    whole = (place + words - 1 <= last) | (np.repeat(per, per) < words) & (place == np.repeat(np.cumsum(per) - per, per))
    up, down = powers.of(len(flat))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up)))
    s, e = starts[whole], ends[to[whole]]
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    own = np.bincount(doc[whole], minlength=len(texts))
    at, sets = 0, []
    for n in own:
        sets.append(np.unique(h[at : at + n]))
        at += n
    return (np.concatenate(sets) if sets else h), np.fromiter(map(len, sets), np.int64, len(sets))


def expand(starts, counts):
    """Positions s, s+1, ..., s+n-1 for each start and count, and which of them each belongs to."""
    import numpy as np

    total = np.cumsum(counts)
    which = np.repeat(np.arange(len(counts)), counts)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - counts - starts, counts), which


def chosen_paths(flat, counts, runs: int, depth: int, threshold: float):
    """For each level: (documents, nodes), a node as its key and that of its parent, which is 0 at the first level."""
    import numpy as np

    starts = np.cumsum(counts) - counts
    share = np.minimum(2.0**64 / (threshold * np.maximum(counts, 1)), 2.0**64 - 4096).astype(np.uint64)
    levels: list[list] = [[] for _ in range(depth)]
    for run in range(runs):
        doc = np.flatnonzero(counts)
        node = np.full(len(doc), mix(np.array([run + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
        for level in range(depth):
            at, which = expand(starts[doc], counts[doc])
            h = flat[at]
            on = mix(h ^ node[which]) < share[doc][which]
            which, h = which[on], h[on]
            parent = node[which]
            node = mix(h + parent * np.uint64(0xD1B54A32D192ED03))
            doc = doc[which]
            levels[level].append((doc, np.stack((parent if level else np.zeros_like(parent), node), axis=1)))
    return [(np.concatenate([d for d, _ in x]), np.concatenate([k for _, k in x])) for x in levels]


def sketches(flat, counts):
    """For each set, 16 bits of its smallest hash in each of BINS ranges; 0 where the range has none."""
    import numpy as np

    out = np.zeros((len(counts), BINS), np.uint16)
    key = np.repeat(np.arange(len(counts)) * BINS, counts) + (flat >> np.uint64(58)).astype(np.int64)
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    out.reshape(-1)[key[first]] = (mix(flat[first]) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def allowed(a, b, na, nb, threshold: float):
    """Whether sketches (arrays that broadcast, bins last) and sizes allow this similarity."""
    import numpy as np

    used = np.maximum(((a != 0) | (b != 0)).sum(-1), 1)
    same = ((a == b) & (a != 0)).sum(-1)
    fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb) * (1 - 1e-9)
    return fits & (same / used >= threshold - 4.5 * np.sqrt(threshold * (1 - threshold) / used))


def runs_for(recall: float, depth: int) -> int:
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def entries(docs: DataFrame, words: int, threshold: float, runs: int, depth: int, batch_chars: int = 1_500_000) -> DataFrame:
    """doc_id, sid (digest of the set; null for none), txt (digest of the text), n, sketch, and nodes by level, packed."""

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        powers = Powers()

        def rows(ids, texts):
            flat, counts = ngram_sets(texts, words, powers)
            sums = np.zeros((len(counts), 2), np.uint64)
            has = np.flatnonzero(counts)
            if len(has):
                begin = (np.cumsum(counts) - counts)[has]
                sums[has, 0], sums[has, 1] = np.add.reduceat(mix(flat), begin), np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
            sketch = sketches(flat, counts)
            by_level = [[b""] * len(counts) for _ in range(depth)]
            for level, (doc, key) in enumerate(chosen_paths(flat, counts, runs, depth, threshold)):
                order = np.argsort(doc, kind="stable")
                ends = np.cumsum(np.bincount(doc, minlength=len(counts)))
                packed = key[order].tobytes()
                width = 16
                for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends)):
                    by_level[level][i] = packed[a * width : z * width]
            frame = pd.DataFrame({
                "doc_id": ids, "sid": [sums[i].tobytes() if counts[i] else None for i in range(len(counts))],
                "txt": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], "n": counts.astype("int32"), "sketch": [x.tobytes() for x in sketch],
            })
            for level in range(depth):
                frame[f"level{level + 1}"] = by_level[level]
            return frame

        for pdf in batches:
            ids, texts, raws, chars = [], [], [], 0
            for doc, text, raw in zip(pdf["doc_id"].array, pdf["text"].array, pdf["raw"].array):
                ids.append(doc)
                texts.append(text or "")
                raws.append(raw)
                chars += len(texts[-1])
                if chars > batch_chars:
                    yield rows(ids, texts).assign(raw=raws)
                    ids, texts, raws, chars = [], [], [], 0
            if ids:
                yield rows(ids, texts).assign(raw=raws)
        pdf = ids = texts = raws = powers = None
        give_back()

    levels = "".join(f", level{i + 1} binary" for i in range(depth))
    return id_back(id_and_text(docs).withColumn("raw", raw_digest()).mapInPandas(mapped, "doc_id string, sid binary, txt binary, n int, sketch binary" + levels + ", raw long"))


def nodes(rows: DataFrame, level: int) -> DataFrame:
    """(sid, key, parent) of all nodes of this level."""

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            packed = np.frombuffer(b"".join(pdf["packed"]), np.int64).reshape(-1, 2)
            counts = [len(x) // 16 for x in pdf["packed"]]
            yield pd.DataFrame({"sid": np.repeat(pdf["sid"].to_numpy(object), counts), "key": packed[:, 1], "parent": packed[:, 0]})

    return rows.filter("sid is not null").select("sid", F.col(f"level{level}").alias("packed")).mapInPandas(mapped, "sid binary, key long, parent long")


def side(sets: DataFrame, c: str) -> DataFrame:
    return sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))


def bounded(df: DataFrame) -> DataFrame:
    """A table with a hint to broadcast it if it has at most BROADCAST_IDS rows (of a key and a count)."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def alike(members: DataFrame, sets: DataFrame, threshold: float, share: float) -> DataFrame:
    """(key) of buckets in which this share of the entries may reach the threshold with the first entry. members: key, sid, size."""
    shown = members.join(sets.select("sid", F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "sid")
    heads = shown.groupBy("key").agg(F.min(F.struct("sid", "n_b", "sketch_b")).alias("h"), F.max("size").alias("size"))
    heads = materialize(heads.select("key", "size", F.col("h.sid").alias("a"), F.col("h.n_b").alias("n_a"), F.col("h.sketch_b").alias("sketch_a")), "heads")
    few = F.broadcast(heads) if heads.count() <= BROADCAST_IDS // 16 else heads
    near = passing(shown.drop("size").join(few, "key").filter("sid <> a"), threshold, "key long").groupBy("key").agg(F.count("*").alias("near"))
    return near.join(heads.select("key", "size"), "key").filter(F.col("near") >= share * (F.col("size") - 1)).select("key")


def buckets(rows: DataFrame, sets: DataFrame, depth: int, small: int, threshold: float, share: float = 0.9) -> DataFrame:
    """(key, sid): the buckets of at least two entries, at the level where they are small or alike, or at the last."""
    found, wide = None, None
    for level in range(1, depth + 1):
        here = nodes(rows, level)
        if wide is not None:
            here = here.join(bounded(wide.select(F.col("key").alias("parent"))), "parent", "left_semi")
        here = materialize(here.select("key", "sid").distinct(), f"nodes{level}")
        sizes = materialize(here.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("digest")).filter("size > 1"), f"sizes{level}")
        wide = sizes.filter(F.col("size") > small)
        if level < depth:
            same = materialize(alike(here.join(bounded(wide.select("key", "size")), "key"), sets, threshold, share), f"alike{level}")
            wide = materialize(wide.join(same, "key", "left_anti"), f"wide{level}")
        ends = sizes if level == depth else sizes.join(wide.select("key"), "key", "left_anti")
        # Buckets with the same entries are one.
        ends = materialize(ends.groupBy("size", "digest").agg(F.min("key").alias("key")).select("key", "size"), f"ends{level}")
        part = here.join(bounded(ends), "key")
        found = part if found is None else found.unionByName(part)
        if level < depth and not wide.limit(1).count():
            break
    ends = found.groupBy("size", "key").agg(F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("digest")).groupBy("size", "digest").agg(F.min("key").alias("key")).select("key")
    return materialize(found.join(ends, "key", "left_semi").select("key", "sid", "size"), "buckets")


def passing(pairs: DataFrame, threshold: float, schema: str = "a binary, b binary") -> DataFrame:
    """Of pairs with sketches and sizes, those that may reach the threshold."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
                yield pdf.loc[allowed(a, b, pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy(), threshold), columns]

    return pairs.mapInPandas(mapped, schema)


def block_pairs(members: DataFrame, group: str, size_col: str, block: int) -> DataFrame:
    """Each member of a group with all pairs (lo, hi) of blocks that hold its own; a group of one block has the pair (0, 0)."""
    n = F.ceil(F.col(size_col) / block)
    own = F.pmod(F.xxhash64("sid", F.lit(7)), n)
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other").withColumn("side", F.col("own") == F.col("lo"))


def across(rest: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges (a, b) between different parts of a bucket that connect all parts with a pair that passes; a tree of them, not all pairs.

    rest: key, size, sid, part, sketch, n.
    """

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for (_, lo, hi), pdf in runs(batches, ["key", "lo", "hi"]):
            left = np.arange(len(pdf)) if lo == hi else np.flatnonzero(pdf["side"])
            right = left if lo == hi else np.flatnonzero(~pdf["side"])
            if not len(left) or not len(right):
                continue
            sketch, n, sid = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(-1, BINS), pdf["n"].to_numpy(), pdf["sid"].to_numpy(object)
            label = pd.factorize(pdf["part"])[0]
            out = []
            for i in left:
                # Entries of i's part are connected with it already.
                j = right[label[right] != label[i]]
                j = j[allowed(sketch[i][None], sketch[j], n[i], n[j], threshold)]
                for part in np.unique(label[j]):
                    out.append((sid[i], sid[j[label[j] == part][0]]))
                    label[label == part] = label[i]
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = block_pairs(rest, "key", "size", block).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInPandas(mapped, "a binary, b binary").distinct()


def exact_links(members: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """(sid, root, links) by block pair: the texts linked to sid, and the smallest entry that it is connected with there.

    members: part, size, sid, set, texts.
    """
    num, den = threshold.numerator, threshold.denominator

    def solved(left, right):
        """left, right: (sids, sets, texts); right is None within a block."""
        import numpy as np

        sids, sets, texts = left if right is None else tuple(a + b for a, b in zip(left, right))
        m, n = len(sids), len(left[0])
        size = np.fromiter(map(len, sets), np.int64, m)
        token = np.concatenate(sets)
        row = np.repeat(np.arange(m), size)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        new = np.concatenate(([True], token[1:] != token[:-1]))
        column = np.cumsum(new) - 1
        often = np.bincount(column)[column] > 1
        row, column = row[often], np.unique(column[often], return_inverse=True)[1]
        common = np.zeros((n, m if right is None else m - n), np.float32)
        edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 2048, 2048))
        for a, z in zip(edges, edges[1:]):
            if a < z:
                x = np.zeros((m, 2048), np.float32)
                x[row[a:z], column[a:z] - column[a] // 2048 * 2048] = 1
                common += x[:n] @ (x if right is None else x[n:]).T
        common = common.astype(np.int64)
        other = size if right is None else size[n:]
        link = common * (num + den) >= num * (size[:n, None] + other[None])
        weight = np.array(texts, np.int64)
        if right is None:
            np.fill_diagonal(link, False)
            links = link @ weight
            whole = link
        else:
            links = np.concatenate((link @ weight[n:], link.T @ weight[:n]))
            whole = None
        rank = np.argsort(np.argsort(np.array(sids, object), kind="stable"), kind="stable")
        label = rank.copy()
        while True:
            if right is None:
                near = np.where(whole, label[None], m).min(1, initial=m)
            else:
                near = np.concatenate((np.where(link, label[None, n:], m).min(1, initial=m), np.where(link.T, label[None, :n], m).min(1, initial=m)))
            now = np.minimum(label, near)
            if (now == label).all():
                break
            label = now
        by_rank = np.argsort(rank)
        return [(sids[i], sids[by_rank[label[i]]], int(links[i])) for i in range(m)]

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def columns(pdf):
            return list(pdf["sid"]), [np.frombuffer(x, np.uint64) for x in pdf["set"]], list(pdf["texts"])

        out = []
        for (_, lo, hi), pdf in runs(batches, ["part", "lo", "hi"]):
            if lo == hi:
                out += solved(columns(pdf), None)
            elif pdf["side"].any() and not pdf["side"].all():
                out += solved(columns(pdf[pdf["side"]]), columns(pdf[~pdf["side"]]))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["sid", "root", "links"])
                out = []
        yield pd.DataFrame(out, columns=["sid", "root", "links"])
        pdf = out = None
        give_back()

    dealt = block_pairs(members, "part", "size", block).repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi")
    return dealt.mapInPandas(mapped, "sid binary, root binary, links long")


def needed_sets(docs: DataFrame, wanted: DataFrame, words: int, batch_chars: int = 1_500_000) -> DataFrame:
    """(sid, set) of the wanted entries (sid, doc): their texts are read again, since few are wanted."""

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        powers = Powers()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            at = 0
            while at < len(texts):
                z, chars = at, 0
                while z < len(texts) and (z == at or chars + len(texts[z]) <= batch_chars):
                    chars += len(texts[z])
                    z += 1
                flat, counts = ngram_sets(texts[at:z], words, powers)
                out, p = [], 0
                for n in counts:
                    s = flat[p : p + n]
                    p += n
                    if n:
                        sums = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64)
                        out.append((sums.tobytes(), s.tobytes()))
                yield pd.DataFrame(out, columns=["sid", "set"])
                at = z
        pdf = texts = out = powers = flat = s = None
        give_back()

    ids = wanted.filter("doc is not null").select(F.col("doc").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(ids, "doc_id", "left_semi").unionByName(rows.filter("doc_id is null"))
    sets = rows.mapInPandas(mapped, "sid binary, set binary")
    return sets.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("set").alias("set"))


def classified(docs: DataFrame, words: int = 5, threshold: str = "0.8", recall: float = 0.98, depth: int = 3, small: int = 64, block: int = 2048) -> DataFrame:
    """doc_id, class_id, class_size, n_links, raw for every row of docs."""
    exact = Fraction(threshold)
    level = float(exact)
    rows = materialize(entries(docs, words, level, runs_for(recall, depth), depth), "ngram-entries")
    texts = rows.filter("sid is not null").groupBy("sid", "txt").agg(F.count("*").alias("docs"), F.min("doc_id").alias("doc"))
    # n and sketch follow from the set, so any row of it has them.
    shape = rows.filter("sid is not null").select("sid", "n", "sketch").groupBy("sid").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    sets = materialize(texts.groupBy("sid").agg(F.sum("docs").alias("docs"), F.count("*").alias("texts"), F.min("doc").alias("doc")).join(shape, "sid"), "ngram-sets")

    held = buckets(rows, sets, depth, small, level)
    heads = held.groupBy("key").agg(F.min("sid").alias("a"))
    pairs = held.join(heads, "key").filter("sid <> a").select("a", F.col("sid").alias("b")).distinct()

    pairs = materialize(passing(pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b"), level), "ngram-pairs")
    parts = components(pairs)

    def part_of(frame, by):
        named = by.select(F.col("node").alias("sid"), "root")
        return frame.join(named, "sid", "left").withColumn("part", F.coalesce("root", "sid")).drop("root")

    placed = part_of(held, parts)
    open_keys = placed.filter("size > 2").groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("key")
    rest = placed.join(open_keys, "key", "left_semi").join(sets.select("sid", "n", "sketch"), "sid")
    more = materialize(across(rest, level, block), "ngram-more")
    if more.limit(1).count():
        parts = components(pairs.unionByName(more))

    members = parts.select(F.col("node").alias("sid"), F.col("root").alias("part")).unionByName(parts.select(F.col("root").alias("sid"), F.col("root").alias("part")).distinct())
    members = members.join(members.groupBy("part").agg(F.count("*").alias("size")), "part").join(sets.select("sid", "texts", "doc"), "sid")
    members = materialize(members, "ngram-members")
    found = materialize(needed_sets(docs, members.select("sid", "doc"), words), "ngram-needed")
    linked = materialize(exact_links(members.join(found, "sid"), exact, block), "ngram-links")
    links = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(linked.filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")).distinct())

    known = part_of(sets.select("sid", "docs", "texts", "doc"), classes).join(links, "sid", "left")
    sizes = known.groupBy("part").agg(F.min("doc").alias("class_id"), F.sum("docs").alias("class_size"))
    known = known.join(sizes, "part").select("sid", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    with_sets = rows.filter("sid is not null").select("doc_id", "raw", "sid").join(known, "sid").select("doc_id", "class_id", "class_size", "n_links", "raw")
    blank = rows.filter("sid is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), "raw")
    return with_sets.unionByName(blank)


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size, n_links for every row of docs."""
    return classified(docs, **options).drop("raw")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs with the smallest doc_id of each class, and all rows without n-grams; the columns of docs.

    A class without any doc_id is kept whole, since nothing tells its rows apart.
    """
    return without(docs, classified(docs, **options).filter("class_id is not null AND (doc_id is null OR doc_id <> class_id)"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
