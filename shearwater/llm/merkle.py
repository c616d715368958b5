"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A section ends with a blank line, a paragraph is a line, and a leaf a sentence
of it (a sentence without an end is cut every LONGEST code points).  Cuts drop
nothing: the leaves in order are the text.  A leaf's hash is that of its text,
a paragraph's that of its leaves' hashes, a section's that of its paragraphs'
and the root (SHA-256) that of its sections'.  So equal roots mean equal
texts, and an edit changes just the branches above it: walking down from
differing sections to differing paragraphs locates it.

Everything here is DataFrame expressions.  The next document in doc_id order
is found without sorting all rows in one task: BUCKETS quantiles of the ids
cut the order into ranges, each range is a window of its own, and only the
first row of each is also sent to the range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of ids: at most SIDE * SIDE, each of about ROWS documents or more.
SIDE, ROWS = 64, 256
#: Code points of a sentence without an end after which a leaf ends.
LONGEST = 80
_LEAF = r"(?<=[.!?])(?=\s)|(?<=\G.{%d})" % LONGEST
_LOWEST = -(1 << 63)


def _cut(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern, -1), lambda x: x != "")


def tree(text: Column) -> Column:
    """Sections as structs (hash, paragraphs), those as structs (hash, leaves); null counts as empty."""

    # leaves first, then a level of hashes at a time over what stands: no lambda names a computed value twice
    found = F.transform(_cut(F.coalesce(text, F.lit("")), r"(?<=\n\n)|(?<=\n[ \t]\n)"), lambda s: F.transform(_cut(s, r"(?<=\n)"), lambda p: F.transform(_cut(p, _LEAF), lambda x: F.xxhash64(x))))
    hashed = F.transform(found, lambda s: F.transform(s, lambda p: F.struct(F.xxhash64(p).alias("hash"), p.alias("leaves"))))
    return F.transform(hashed, lambda s: F.struct(F.xxhash64(F.transform(s, lambda p: p["hash"])).alias("hash"), s.alias("paragraphs")))


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def root(t: Column) -> Column:
    return F.sha2(F.array_join(F.transform(t, lambda s: _hex(s["hash"])), ","), 256)


def written(t: Column) -> Column:
    """A tree as text: ``root:section=paragraph+leaf.leaf,paragraph+leaf/section=...``, hashes in hex."""
    paragraph = lambda p: F.concat(_hex(p["hash"]), F.lit("+"), F.array_join(F.transform(p["leaves"], _hex), "."))
    section = lambda s: F.concat(_hex(s["hash"]), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(root(t), F.lit(":"), F.array_join(F.transform(t, section), "/"))


def fingerprint(text: Column) -> Column:
    return written(tree(text))


def leaves(t: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(t, lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if the roots of two trees agree, else their common distinct leaves over all distinct leaves.

    Branches with equal hashes have equal leaves, so this is what a walk down
    the differing branches leaves over; done on the leaves it is linear.
    """
    x, y = leaves(a), leaves(b)
    both = F.size(F.array_intersect(x, y))
    same = F.transform(a, lambda s: s["hash"]) == F.transform(b, lambda s: s["hash"])
    return F.when(same, F.lit(1.0)).otherwise(both.cast("double") / (F.size(x) + F.size(y) - both))


def edits(pairs: DataFrame) -> DataFrame:
    """Paragraphs that one text has and the other not: (id, side, section, paragraph), numbers from 0.

    ``pairs`` has (id, old, new), unique by id.  The walk goes down only under
    sections whose hash the other tree doesn't have; a paragraph is reported
    where the other text has none with its hash, however far an insertion
    moved it.  ``side`` is ``old`` for what went and ``new`` for what came.
    Null texts count as empty; equal texts, and texts that only order the same
    paragraphs differently, give no rows.
    """
    both = pairs.select("id", F.explode(F.array(F.struct(F.lit("old").alias("side"), tree(F.col("old")).alias("t")), F.struct(F.lit("new").alias("side"), tree(F.col("new")).alias("t")))).alias("x"))
    sections = both.select("id", "x.side", F.posexplode("x.t").alias("section", "s"))
    sides = lambda rows, key: rows.groupBy("id", F.col(key).alias("hash")).agg(F.count_distinct("side").alias("sides")).where("sides = 2")
    branch = sections.select("id", "side", "section", F.col("s.hash").alias("hash"), "s.paragraphs")
    open_ = branch.join(sides(branch, "hash"), ["id", "hash"], "left_anti")
    paragraphs = open_.select("id", "side", "section", F.posexplode("paragraphs").alias("paragraph", "p")).select("id", "side", "section", "paragraph", F.col("p.hash").alias("hash"))
    # the other text may hold a paragraph in a section that both have
    every = branch.select("id", "side", F.explode("paragraphs.hash").alias("hash"))
    return paragraphs.join(sides(every, "hash"), ["id", "hash"], "left_anti").select("id", "side", "section", "paragraph")


def ranges(rows: DataFrame) -> list[int]:
    """Quantiles of ``k``: at most SIDE * SIDE - 1 numbers, equal ones where a number is that frequent."""
    n = min(SIDE * SIDE, max(1, rows.count() // ROWS))
    if n == 1:
        return []
    at = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0]
    return [] if at is None else list(at)


def bucket(bounds: list[int], k: Column, h: Column) -> Column:
    """Number of the range of (k, h): ids equal to several bounds are dealt by h, in order."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + SIDE] for i in range(0, len(bounds), SIDE)]
    table = F.array(*(F.array(*map(F.lit, p)) for p in parts))

    def upto(test) -> Column:
        whole = F.size(F.filter(F.array(*(F.lit(p[-1]) for p in parts)), test))  # parts that end below
        rest = F.coalesce(F.size(F.filter(F.get(table, whole), test)), F.lit(0))
        return whole * SIDE + F.when(whole < len(parts), F.greatest(rest, F.lit(0))).otherwise(len(parts[-1]) - SIDE)

    low, high = upto(lambda b: b < k), upto(lambda b: b <= k)
    share = F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * (high - low)), high - low - 1)
    return F.when(high - low > 1, low + 1 + share).otherwise(high).cast("int")


def chained(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tree, next_text, next_tree): each document beside the next one in order.

    Order: doc_id (null first), then a hash of the text; rows equal in both
    are one after the other.  After the last comes the first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("bucket", bucket(ranges(rows), F.col("k"), F.col("h")))
    first = rows.groupBy("bucket").agg(F.min(F.struct("k", "h", "text")).alias("f"))
    filled = rows.select("bucket").distinct()  # at most SIDE * SIDE rows
    before = filled.select("bucket", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy())).alias("target"))
    guest = first.join(before, "bucket").select(
        F.lit(None).cast("long").alias("doc_id"), F.col("f.text").alias("text"), F.col("f.k").alias("k"), F.col("target").alias("bucket"), F.col("f.h").alias("h"), F.lit(True).alias("guest"),
    )
    every = rows.select("doc_id", "text", "k", "bucket", "h", F.lit(False).alias("guest")).unionByName(guest)
    every = every.withColumn("tree", tree(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", "k", "h")
    return (
        every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_tree", F.lead("tree").over(order))
        .where("not guest").select("doc_id", "text", "tree", "next_text", "next_tree")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n/2) code points replaced by as many
    first ones (or all) of the next document.  Null texts count as empty.  One
    row per input row, repeated rows too; a table of one document is its own
    next; an empty table gives no rows; a null doc_id comes first.  Texts may
    have any length.  Other columns are ignored.
    """
    rows = chained(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_tree", tree(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("tree")).alias("fingerprint"), written(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
