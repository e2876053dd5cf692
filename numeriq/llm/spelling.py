"""Spelling variants: words of a corpus within one edit of each other, by an index of variable-length grams.

Words are maximal runs of A-Z, a-z and U+00C0-U+00FF in whole texts, lower-cased in A-Z. With h the crc32 of `<doc_id>:<run>`, a run whose h 97 divides
loses its code point h % length. Distinct results of at least 5 code points that occur at least 3 times are the words. Two are near if one inserted,
deleted or replaced code point makes one of the other. A word's form is its near word of largest n (ties: the first in code-point order) if that is at
least twice its own n; the root follows forms to the last.

1. The dictionary counts grams by length of word and place, words padded with `^` and `$`. A gram of more than `limit` words is pruned in favour of its
   extensions, up to half a word. Pruned grams with their counts are broadcast; `limit` rises with the vocabulary so that there are at most DICTIONARY.
2. A word's gram at a place is the shortest that isn't pruned. Each edit affects the grams over its place; a set of grams larger than the most that one
   edit affects leaves one that a near word must share, at its place, or one further where a longer word has its extra code point before it. The
   smallest such sets are two grams without a common place, and the rarest two are the lists of the word.
3. Lists are dealt by gram. Every word probes the lists of its own length and of the next shorter one; what it meets is verified there, in blocks. Only
   near pairs leave the task. A list that stays long at half a word is dealt in parts, and probes go to all of them.

Null texts have no words, a null doc_id is empty in `<doc_id>:`, repeated rows count each, an empty table has no words. Words longer than 40 code points
have grams at 8 places only, so a word of any length is copied a bounded number of times. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, lean, materialize, table

LETTERS = "a-zÀ-ÿ"
#: Pruned grams at most, least count of a gram that is pruned, and words of a list that are dealt together.
DICTIONARY, LEAST, PART = 300_000, 64, 8192
#: Words of a task that are counted before they are sent on; bytes that are compared at once.
HELD_WORDS, COMPARED = 300_000, 8 << 20


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n)."""

    def counted(batches: Iterator) -> Iterator:
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        runs = re.compile(f"[{LETTERS}]+").findall
        held: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter(runs((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % 97 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield batch()
                    held.clear()
        yield batch()

    found = id_and_text(docs).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def places(length: int) -> list[int]:
    """Where grams of words of this length begin, in the padded word."""
    return list(range(length + 1)) if length <= 40 else list(range(0, length + 1, -(-length // 8)))


def longest(length: int) -> int:
    return (length + 2) // 2


def pruned_grams(words: DataFrame) -> dict[tuple[int, int], dict[str, int]]:
    """Counts of the grams that are pruned, by length of word and place: at most DICTIONARY of them."""
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    length = F.length("word")
    step = F.when(length <= 40, 1).otherwise(F.ceil(length / 8).cast("int"))
    most = F.least(F.lit(20), F.floor((length + 2) / 2).cast("int"))
    at = words.select(padded.alias("padded"), length.alias("length"), most.alias("most"), F.explode(F.sequence(F.lit(0), length, step)).alias("place"))
    sizes = F.explode(F.sequence(F.lit(2), F.least("most", F.col("length") + 2 - F.col("place")))).alias("size")
    grams = at.filter("place <= length").select("length", "place", "padded", sizes).select("length", "place", F.expr("substr(padded, place + 1, size)").alias("gram"))
    size = words.agg(F.coalesce(F.sum((length + 1) * (most - 1)), F.lit(0))).first()[0]
    limit = max(LEAST, -(-size // DICTIONARY))
    out: dict[tuple[int, int], dict[str, int]] = {}
    for r in grams.groupBy("length", "place", "gram").agg(F.count("*").alias("n")).filter(F.col("n") > limit).toLocalIterator():
        out.setdefault((r["length"], r["place"]), {})[r["gram"]] = r["n"]
    return out


def gram_at(padded: str, begin: int, most: int, pruned: dict[str, int]) -> str:
    """The shortest gram from begin that isn't pruned; the longest possible if all are."""
    end, last = begin + 2, min(len(padded), begin + most)
    while end < last and padded[begin:end] in pruned:
        end += 1
    return padded[begin:end]


def lists_of(padded: str, length: int, pruned: dict) -> list[tuple[int, str]]:
    """The two rarest grams (place, gram) that no one edit affects both."""
    none: dict[str, int] = {}
    grams = []
    for p in places(length):
        here = pruned.get((length, p), none)
        g = gram_at(padded, p, longest(length), here)
        grams.append((here.get(g, 0), p, p + len(g), g))
    grams.sort()
    best = None
    for k, (n, p, e, g) in enumerate(grams):
        if best and n >= best[0]:
            break
        for m, q, f, h in grams[k + 1 :]:
            if (e <= q or f <= p) and (not best or n + m < best[0]):
                best = n + m, [(p, g), (q, h)]
                break
    return best[1]


def decomposed(words: DataFrame, pruned: dict) -> DataFrame:
    """Rows of lists (size 0) and of probes (size: the word's length), by key: bits of length and place, and a hash of the gram.

    Keys that meet by chance only add pairs to verify."""
    held = words.sparkSession.sparkContext.broadcast(pruned)

    def mapped(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        pruned, none = held.value, {}

        def keys(length, place, gram, wid):
            n = pruned.get((length, place), none).get(gram, 0)
            high = (length % 0x8000 << 48) | (place % 0x10000 << 32)
            parts = -(-n // PART)
            if parts <= 1:
                return [high | zlib.crc32(gram.encode())]
            return [high | zlib.crc32(f"{gram}{b}".encode()) for b in ([wid % parts] if wid is not None else range(parts))]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["key", "size", "wid", "word", "n"])

        for b in batches:
            out, size = [], 0
            for wid, word, n in zip(b["wid"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist()):
                padded, length = f"^{word}$", len(word)
                found = {(k, 0) for p, g in lists_of(padded, length, pruned) for k in keys(length, p, g, wid)}
                for p in places(length):
                    found |= {(k, length) for k in keys(length, p, gram_at(padded, p, longest(length), pruned.get((length, p), none)), None)}
                for p in places(length - 1):
                    for begin in (p, p + 1):
                        found |= {(k, length) for k in keys(length - 1, p, gram_at(padded, begin, longest(length - 1), pruned.get((length - 1, p), none)), None)}
                out += [(k, s, wid, word, n) for k, s in found]
                size += len(found) * (length + 32)
                if size > COMPARED:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    return words.select(F.xxhash64("word").alias("wid"), "word", "n").mapInArrow(mapped, "key long, size int, wid long, word string, n long")


def near_in_chunk(key, size, wid, word) -> tuple:
    """Places (list row, probe row) of near words in rows sorted by key and size."""
    import numpy as np

    found = []
    held = np.flatnonzero(size == 0)
    sizes = np.fromiter(map(len, word[held]), np.int64, len(held))
    for length in np.unique(sizes).tolist():
        lists = held[sizes == length]
        for extra in (0, 1):
            probes = np.flatnonzero(size == length + extra)
            if not len(probes):
                continue
            a, b = (np.frombuffer("".join(word[r]).encode("latin-1"), np.uint8).reshape(len(r), -1) for r in (lists, probes))
            low, high = np.searchsorted(key[lists], key[probes]), np.searchsorted(key[lists], key[probes], "right")
            ends = np.cumsum(high - low)
            step, at = max(1, COMPARED // (length + extra)), 0
            while at < len(probes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
                n = high[at:to] - low[at:to]
                j = np.repeat(np.arange(at, to), n)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
                at = to
                if not extra:
                    once = wid[lists[i]] <= wid[probes[j]]
                    i, j = i[once], j[once]
                    near = (a[i] != b[j]).sum(1) == 1
                else:
                    # Equal up to some place, and from there on with the longer word moved by one.
                    differs, moved = a[i] != b[j, :-1], a[i] != b[j, 1:]
                    first = np.where(differs.any(1), differs.argmax(1), length)
                    last = np.where(moved.any(1), length - moved[:, ::-1].argmax(1), 0)
                    near = first >= last
                found.append((lists[i[near]], probes[j[near]]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found] or [none]) for k in (0, 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of near words once, the smaller word first."""

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def pairs(t):
            key, size, wid, n = (t[c].to_numpy() for c in ("key", "size", "wid", "n"))
            word = np.array(t["word"].to_pylist(), object)
            i, j = near_in_chunk(key, size, wid, word)
            out = {(word[a], int(n[a]), word[b], int(n[b])) if word[a] < word[b] else (word[b], int(n[b]), word[a], int(n[a])) for a, b in zip(i.tolist(), j.tolist())}
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])

        held: list = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) > COMPARED:
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield pairs(t.slice(0, cut))
                    t = t.slice(cut)
                held = t.combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    rows = decomposed(words, pruned_grams(words))
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * words.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key", "size")
    return dealt.mapInArrow(mapped, "word string, n long, near string, near_n long").distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form). Each round doubles the forms followed, and counts double along them, so rounds are few."""
    state = materialize(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "spelling-forms")
    while not state.filter("NOT done").isEmpty():
        next_ = state.select(F.col("word").alias("root"), F.col("root").alias("__next"), F.col("done").alias("__done"))
        met = state.filter("NOT done").join(next_, "root", "left")
        moved = met.select("word", F.coalesce("__next", "root").alias("root"), F.coalesce("__done", F.lit(True)).alias("done"))
        state = materialize(moved.unionByName(state.filter("done")), "spelling-roots")
    return state.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the documents."""
    words = materialize(lean(word_counts(docs)), "spelling-words")
    pairs = materialize(near_words(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("b.less") >= 2 * F.col("n"), F.struct(F.col("b.near").alias("form"), (-F.col("b.less")).alias("n"))).alias("f"))
    found = materialize(found.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "spelling-best")
    roots = rooted(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
