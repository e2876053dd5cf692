"""A dataset's Merkle manifest: a content-addressed DAG of digests, and proofs read from it by descent.

H is lower-case hex SHA-256 of its inputs, concatenated, digests as hex text. Each row's leaf is H over doc_id, source, lang, n_chars and text: `-` where
null, else the count of UTF-8 bytes, `:` and the value. Leaves of a language, ascending by doc_id, are folded two by two (a last odd one alone) to its
subroot, and the subroots, null first and then bytewise by language, to the root. A language of one leaf has that leaf as subroot; one subroot is the root.

1. Leaves get their place in their language by ranges of (language, doc_id): no task holds a language.
2. `build` stores records by digest: a node with the digests of the BITS levels below it, so at most 2^BITS children. Equal nodes are one record.
3. `descend` starts requests (tree, place) at the root. Each round looks up the node's record by digest, picks the child by the next BITS binary digits of
   the place, and appends the unselected siblings of that segment. Requests with the same leading digits travel as one row; only the last round has as many
   rows as leaves. The segments, met from the root down, are reversed to give the path from the leaf up.

All of it is DataFrame functions. Nulls: a null language is a language of its own; a null doc_id comes first and is never tampered with, nor is a null
n_chars. Ties of doc_id go by leaf; repeated rows are leaves of their own, and which of them has which place makes no difference. Texts of any length are
hashed in one pass and not shuffled. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Levels in a record, and digits of a place taken at once.
BITS = 8
#: Leaves in a range of places.
RANGE_ROWS = 100_000


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def tree_of(lang: Column) -> Column:
    """A name that sorts as languages do, null first."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang.cast("string")))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and altered: the leaf with n_chars raised by one where 7 divides crc32 of the decimal doc_id, else null; digests as bytes."""
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    more = c | {"n_chars": c["n_chars"].cast("decimal(20,0)") + 1}
    chosen = F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0
    altered = F.when(chosen & c["n_chars"].isNotNull(), F.unhex(leaf_digest(**more)))
    return docs.select(tree_of(c["lang"]).alias("tree"), c["doc_id"].cast("long").alias("doc_id"), F.unhex(leaf_digest(**c)).alias("leaf"), altered.alias("altered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, from 0, in the order of their tree, and n, the tree's count. Ranges are sorted on their own and shifted by what lies before them."""
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    keys = [F.col("tree"), *map(F.col, order)]
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    dealt = materialize(salted.repartitionByRange(parts, *keys, "__salt").withColumn("__part", F.spark_partition_id()).drop("__salt"), "merkle-ranges")
    counts = dealt.groupBy("tree", "__part").agg(F.count("*").alias("__n"))
    tree = Window.partitionBy("tree")
    before = F.sum("__n").over(tree.orderBy("__part")) - F.col("__n")
    starts = counts.select("tree", "__part", before.alias("__before"), F.sum("__n").over(tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("__part", "tree").orderBy(*order)) - 1
    return dealt.join(starts, ["tree", "__part"]).withColumn("place", within + F.col("__before")).drop("__part", "__before")


def height(n: Column) -> Column:
    """Levels above n leaves: binary digits of n - 1."""
    return F.when(n == 1, 0).otherwise(F.length(F.bin(n - 1)))


def counting(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def folded(digests: Column, levels: Column) -> Column:
    """The digests, their pairs' digests and so on: levels + 1 arrays."""

    def pairs(row: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(row) - 1).cast("int") - F.floor(F.size(row) / 2).cast("int")), lambda i: sha(F.get(row, i * 2), F.coalesce(F.get(row, i * 2 + 1), F.lit(""))))

    return F.aggregate(counting(levels), F.array(digests), lambda done, _: F.concat(done, F.array(pairs(F.element_at(done, -1)))))


def shifted(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, F.lit(bits) if isinstance(bits, int) else bits)


def build(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(records, roots) of nodes (tree, place, n, digest as hex). records: digest, levels; roots: tree, n, digest."""
    spark = nodes.sparkSession
    records = spark.createDataFrame([], "digest string, levels array<array<string>>")
    now = nodes.select("tree", "place", "n", "digest", height(F.col("n")).alias("left"))
    tallest = now.agg(F.max("left")).first()[0] or 0
    roots = now.filter("left = 0").select("tree", "n", "digest")
    for round_ in range(-(-tallest // bits)):
        blocks = now.filter("left > 0").groupBy("tree", shifted(F.col("place"), bits).alias("place"), "n", "left").agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("held"))
        done = F.least("left", F.lit(bits))
        grown = blocks.withColumn("levels", folded(F.col("held.digest"), done)).withColumn("digest", F.element_at(F.element_at("levels", -1), 1)).withColumn("left", F.col("left") - done)
        now = materialize(grown.select("tree", "place", "n", "digest", "left", "levels"), f"merkle-level-{round_}")
        records = records.unionByName(now.select("digest", "levels"))
        roots = roots.unionByName(now.filter("left = 0").select("tree", "n", "digest"))
    return records.groupBy("digest").agg(F.any_value("levels").alias("levels")), roots


def segment(levels: Column, digit: Column) -> Column:
    """Siblings of a child on its way up through a record, null where it is alone."""
    return F.transform(counting(F.size(levels) - 1), lambda l: F.get(F.get(levels, l), shifted(digit, l).bitwiseXOR(F.lit(1))))


def descend(records: DataFrame, roots: DataFrame, requests: DataFrame, bits: int = BITS) -> DataFrame:
    """requests (tree, place, further columns), roots' other columns, and siblings: array from the leaf up, null where a node is alone."""
    carried = [c for c in roots.columns if c not in ("tree", "n", "digest")]
    asked = [c for c in requests.columns if c not in ("tree", "place")]
    mask = (1 << bits) - 1
    no_path = F.array().cast("array<array<string>>")
    front = roots.select("tree", "digest", *carried, F.ceil(height(F.col("n")) / bits).alias("rounds"), F.lit(0).cast("long").alias("block"), no_path.alias("path"))
    rounds = front.agg(F.max("rounds")).first()[0] or 0

    def opened(front: DataFrame, round_: int) -> DataFrame:
        return front.join(records.withColumnRenamed("digest", "__of"), (F.col("digest") == F.col("__of")) & (F.col("rounds") > round_), "left").drop("__of")

    for round_ in range(rounds - 1, 0, -1):
        wanted = requests.select("tree", shifted(F.col("place"), bits * round_).alias("at")).distinct().withColumn("block", shifted(F.col("at"), bits))
        met = opened(front, round_).join(wanted, ["tree", "block"])
        digit = F.col("at").bitwiseAND(F.lit(mask)).cast("int")
        deeper = F.col("levels").isNotNull()
        child = F.when(deeper, F.get(F.get("levels", F.lit(0)), digit)).otherwise(F.col("digest"))
        path = F.when(deeper, F.concat("path", F.array(segment(F.col("levels"), digit)))).otherwise(F.col("path"))
        front = materialize(met.select("tree", child.alias("digest"), *carried, "rounds", F.col("at").alias("block"), path.alias("path")), f"merkle-front-{round_}")
    packed = requests.groupBy("tree", shifted(F.col("place"), bits).alias("block")).agg(F.collect_list(F.struct("place", *asked)).alias("asked"))
    met = opened(front, 0).join(packed, ["tree", "block"])

    def answered(q: Column) -> Column:
        own = segment(F.coalesce("levels", F.array(F.array().cast("array<string>"))), q["place"].bitwiseAND(F.lit(mask)).cast("int"))
        siblings = F.flatten(F.reverse(F.concat("path", F.array(own))))
        return F.struct(q["place"].alias("place"), *[q[c].alias(c) for c in asked], siblings.alias("siblings"))

    return met.select("tree", *carried, F.explode(F.transform("asked", answered)).alias("q")).select("tree", *carried, "q.*")


def steps(siblings: Column, place: Column) -> Column:
    """Siblings with the side of the node they join: 1 where the node is the right one."""
    return F.transform(siblings, lambda s, l: F.struct(s.alias("sibling"), shifted(place, l).bitwiseAND(F.lit(1)).alias("right")))


def refolded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(way, leaf, lambda d, s: F.when(s["sibling"].isNull(), F.sha2(d, 256)).when(s["right"] == 1, sha(s["sibling"], d)).otherwise(sha(d, s["sibling"])))


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, records, trees). leaves: tree, place, n, doc_id, leaf, altered (bytes); records: digest, levels; trees: tree, n, digest (the subroot), root, upper
    (steps from subroot to root)."""
    own = materialize(placed(materialize(leaves(docs), "merkle-leaves"), "doc_id", "leaf"), "merkle-places")
    records, subroots = build(own.select("tree", "place", "n", F.lower(F.hex("leaf")).alias("digest")))
    records, subroots = materialize(records, "merkle-records"), materialize(subroots, "merkle-subroots")
    named = materialize(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), "digest"), "name"), "merkle-languages")
    above, root = build(named.select("tree", "place", "n", "digest"))
    found = descend(above, root.withColumn("root", F.col("digest")), named.select("tree", "place", "name", "size", F.col("digest").alias("subroot")))
    trees = found.select(F.col("name").alias("tree"), F.col("size").alias("n"), F.col("subroot").alias("digest"), "root", steps(F.col("siblings"), F.col("place")).alias("upper"))
    return own, records, materialize(trees, "merkle-trees")


def proofs(held: tuple[DataFrame, DataFrame, DataFrame], requests: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, altered (hex), subroot, root and way: the steps from the leaf to the root. requests: rows of leaves; all of them where none are given."""
    own, records, trees = held
    asked = (own if requests is None else requests).select("tree", "place", "doc_id", "leaf", "altered")
    found = descend(records, trees.withColumn("subroot", F.col("digest")), asked)
    as_hex = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "altered")}
    return found.select("doc_id", *as_hex.values(), "subroot", "root", F.concat(steps(F.col("siblings"), F.col("place")), F.col("upper")).alias("way"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proofs(manifest(table(spark, sf_dir, "documents")))
    found = found.withColumn("folded_root", refolded(F.coalesce("altered", "leaf"), F.col("way")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("way.sibling", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
