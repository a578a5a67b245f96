"""Merkle dataset manifest by checkpoint and recompute.

Each row is a leaf. The leaves of a source, ordered by id, form a tree in which every run of
``ARITY`` neighbours becomes the digest of their concatenated digests; the subroots, ordered by
source, form one more tree of the same kind.

Only every ``STEP``-th level is stored. A stored row is an aligned subtree: up to ARITY**STEP nodes
of one stored level, in order, with the digest at its top. The levels between are never stored: the
build makes them on the way to the top digest, and proof extraction makes them again from the stored
nodes, takes the siblings and lets them go. Extraction runs from the root down, so what lies above a
subtree is carried once for all its nodes and joined to it by its place.

Places are a distributed rank: rows are dealt by ranges of (source, id, leaf), sorted and numbered
in their partition, and the sizes of earlier partitions are added; a source that holds a third of
all rows spreads over as many partitions as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.llm.common import small
from formatpulse.session import store

ARITY = 3
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each as its byte count, a colon and the value; a hyphen for null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def ranked(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """``rows`` with idx (place within the tree, from 0) and n (rows of the tree); nulls come first."""
    dealt = rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
    stored = store(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    earlier = Window.partitionBy(*tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored.groupBy(*tree, part).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    # one row for each partition and tree that meet
    runs = store(runs.select(
        *tree, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__from")).alias("__shift"),
        F.sum("__n").over(Window.partitionBy(*tree)).alias("n")), "runs")
    placed = stored.withColumn("__part", part).join(small(runs), [*tree, "__part"])
    return placed.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def parents(kids: Column, arity: int) -> Column:
    """Digests of the runs of ``arity`` neighbours in an array of digests that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.size(kids) - 1, F.lit(arity)),
                       lambda i: digest(F.array_join(F.slice(kids, i + 1, arity), "")))


def with_levels(segments: DataFrame, arity: int, step: int) -> DataFrame:
    """Adds __k0 to __k<step>, the levels of each subtree, and __n0 to __n<step>, the nodes of the whole
    tree on them; a tree of one node is done and stays as it is."""
    out = segments.withColumns({"__k0": F.transform("kids", lambda x: x["digest"]), "__n0": F.col("n")})
    for t in range(step):
        more = F.col(f"__n{t}") > 1
        out = out.withColumns({
            f"__k{t + 1}": F.when(more, parents(F.col(f"__k{t}"), arity)).otherwise(F.col(f"__k{t}")),
            f"__n{t + 1}": F.when(more, F.ceil(F.col(f"__n{t}") / arity)).otherwise(F.col(f"__n{t}"))})
    return out


def build(nodes: DataFrame, tree: list[str], arity: int = ARITY, step: int = STEP) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels, lowest first, and (tree, digest) of every top. ``nodes`` has tree, idx, n,
    node (a struct with digest). A stored row is tree, n, up (its place), kids (nodes in order), top, n_up."""
    tables, width = [], arity**step
    while True:
        segments = nodes.groupBy(*tree, "n", F.floor(F.col("idx") / width).alias("up")).agg(  # width nodes at most
            F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("kids"))
        segments = segments.withColumn("kids", F.transform("kids", lambda x: x["node"]))
        full = with_levels(segments, arity, step)
        tables.append(store(full.select(*tree, "n", "up", "kids", F.get(f"__k{step}", F.lit(0)).alias("top"),
                                        F.col(f"__n{step}").alias("n_up")), "level"))
        most = tables[-1].agg(F.max("n_up")).first()[0] or 0
        nodes = tables[-1].select(*tree, F.col("n_up").alias("n"), F.col("up").alias("idx"),
                                  F.struct(F.col("top").alias("digest")).alias("node"))
        if most <= 1:
            return tables, nodes.select(*tree, "node.digest")


def descend(tables: list[DataFrame], tops: DataFrame, tree: list[str], arity: int = ARITY, step: int = STEP) -> DataFrame:
    """(tree, node, path, …) of every lowest node. ``tops`` has tree, path and what else is carried down.
    A path lists, from the node up, l and r: the joined digests of the siblings on each side."""
    carried = [c for c in tops.columns if c not in (*tree, "path")]
    upper = tops.withColumn("up", F.lit(0).cast("long"))
    for table in reversed(tables):
        rows = with_levels(table, arity, step).join(upper, [*tree, "up"])

        def siblings(b: Column) -> Column:
            found = []
            for t in range(step):
                i = F.floor(b / arity**t).cast("int")
                first = i - i % arity
                side = lambda start, size, k=F.col(f"__k{t}"): F.array_join(F.slice(k, start, size), "")
                found.append(F.when(F.col(f"__n{t}") > 1, F.struct(
                    side(first + 1, i - first).alias("l"), side(i + 2, first + arity - 1 - i).alias("r"))))
            return F.filter(F.array(*found), lambda x: x.isNotNull())

        below = rows.select(*tree, "up", "path", *carried, F.posexplode(F.transform(
            "kids", lambda x, b: F.struct(x.alias("node"), siblings(b).alias("below")))).alias("__b", "__x"))
        upper = below.select(*tree, (F.col("up") * arity**step + F.col("__b")).alias("up"), "__x.node",
                             F.concat("__x.below", "path").alias("path"), *carried)
        last, upper = upper, upper.drop("node")
    return last.drop("up")


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, p: digest(F.concat(p["l"], acc, p["r"])))


def manifest(rows: DataFrame, payload: list[str], arity: int = ARITY, step: int = STEP) -> DataFrame:
    """(payload, leaf, subroot, root, path) of every row of ``rows``, which has source, id, leaf and the
    payload columns; ``path`` leads from the leaf by its subroot to the root."""
    tree = ["__known", "__source"]
    keyed = rows.select(F.col("source").isNotNull().alias("__known"), F.coalesce("source", F.lit("")).alias("__source"),
                        "id", "leaf", F.struct(F.col("leaf").alias("digest"), *payload).alias("node"))
    leaves = ranked(keyed, tree, ["id", "leaf"])
    tables, subroots = build(leaves.select(*tree, "idx", "n", "node"), tree, arity, step)
    whole = ["__all"]
    sources = ranked(subroots.withColumn("__all", F.lit(0)), whole, tree)
    sources = sources.select(*whole, "idx", "n", F.struct("digest", *tree).alias("node"))
    root_tables, roots = build(sources, whole, arity, step)
    none = F.array().cast("array<struct<l:string,r:string>>")
    tops = descend(root_tables, roots.select(*whole, F.col("digest").alias("root"), none.alias("path")), whole, arity, step)
    tops = tops.select(*[f"node.{c}" for c in tree], F.col("node.digest").alias("subroot"), "root", "path")
    found = descend(tables, tops, tree, arity, step)
    return found.select(*[f"node.{c}" for c in payload], F.col("node.digest").alias("leaf"), "subroot", "root", "path")


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line ends where crc32 of the id's decimal text is even; nulls stay."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verify_documents(docs: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls in any column count as such in the leaf; a null source is a source of its own and comes first,
    a null id comes first in its source and is never tampered with; empty texts are texts of no bytes; equal ids are
    ordered by leaf, and repeated rows are leaves of their own next to each other; a table without
    rows gives none; further columns are ignored.
    """
    leaf = leaf_digest(*[F.col(c) for c in FIELDS])
    other = leaf_digest(*[tampered_text(F.col("doc_id"), F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    rows = docs.select("source", F.col("doc_id").alias("id"), "doc_id", leaf.alias("leaf"),
                       F.when(changed, other).alias("tampered"))
    found = manifest(rows, ["doc_id", "tampered"], arity, step)
    out = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
