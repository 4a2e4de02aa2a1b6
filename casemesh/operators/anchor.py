"""A hash tree over the heads of a sealed log's chains: one root binds all chains.

Sealed chains are independent, so whoever can rewrite or drop a chain can do the same to its stored head. The root is
kept elsewhere; it changes with any head, and a single head is proved against it with one family of nodes a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_BITS = 4
HEAD = ("chain", "first_seq", "last_seq", "rows", "head_hash")
FAMILY = "array<struct<node: bigint, digest: string>>"


def head_digest() -> Column:
    """Digest of a chain's head; the leaf of the tree."""
    return F.sha2(F.concat_ws("|", F.lit("head"), *(F.col(c).cast("string") for c in HEAD)), 256)


def _joint(family: Column) -> Column:
    """Digest of up to ``2**FAN_BITS`` sibling nodes, in their order."""
    said = F.transform(family, lambda n: F.concat_ws(":", n["node"].cast("string"), n["digest"]))
    return F.sha2(F.concat(F.lit("node|"), F.array_join(said, "|")), 256)


def _family() -> Column:
    return F.array_sort(F.collect_list(F.struct("node", "digest")))  # bounded by the fan


def hash_tree(heads: DataFrame, levels: int | None = None) -> DataFrame:
    """(level, node, digest) of all nodes; a node's number is its children's shifted by FAN_BITS.

    ``heads`` as ``audit.chain_heads`` gives them, stored: they are read once a level. Without ``levels`` the tree goes
    up to where one node is left, which takes one look at the largest chain number. Each level is a grouping of at most
    ``2**FAN_BITS`` rows a key.
    """
    now = heads.select(F.lit(0).alias("level"), F.col("chain").cast("long").alias("node"), head_digest().alias("digest"))
    if levels is None:
        top = heads.agg(F.max("chain")).first()[0] or 0
        levels = -(-int(top).bit_length() // FAN_BITS)
    tree = now
    for level in range(1, levels + 1):
        up = now.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(_family().alias("f"))
        now = up.select(F.lit(level).alias("level"), "node", _joint(F.col("f")).alias("digest"))
        tree = tree.unionByName(now)
    return tree


def root(tree: DataFrame) -> Column:
    """The digest to keep elsewhere, as a scalar."""
    return tree.agg(F.max_by("digest", "level")).scalar()


def prove(tree: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain, proof): for each of ``chains`` the families of nodes on its way up, lowest first."""
    families = tree.groupBy("level", F.shiftright("node", FAN_BITS).alias("parent")).agg(_family().alias("family"))
    depth = tree.agg(F.max("level")).scalar()
    steps = chains.select("chain").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), depth))).filter(F.col("level") < depth)
    steps = steps.withColumn("parent", F.expr(f"shiftright(chain, (level + 1) * {FAN_BITS})"))
    met = steps.join(families, ["level", "parent"])
    proof = F.transform(F.array_sort(F.collect_list(F.struct("level", "family"))), lambda s: s["family"])
    return met.groupBy("chain").agg(proof.alias("proof"))


def proved(heads: DataFrame, proofs: DataFrame, kept_root: Column | str) -> DataFrame:
    """``heads`` with ``proved``: the proof leads from the head to the root. Heads without a proof are not proved."""
    def step(at: Column, family: Column) -> Column:
        own = F.exists(family, lambda n: (n["node"] == at["node"]) & (n["digest"] == at["digest"]))
        return F.struct(F.shiftright(at["node"], FAN_BITS).alias("node"), F.when(own, _joint(family)).alias("digest"))

    start = F.struct(F.col("chain").cast("long").alias("node"), head_digest().alias("digest"))
    end = F.aggregate("proof", start, step, lambda at: at["digest"])
    kept_root = F.lit(kept_root) if isinstance(kept_root, str) else kept_root
    joined = heads.join(proofs, "chain", "left")
    return joined.withColumn("proved", F.coalesce(end == kept_root, F.lit(False))).drop("proof")


def check_tree(heads: DataFrame, tree: DataFrame, kept_root: Column | str) -> DataFrame:
    """(chain, state, root_holds) of every chain now or in the stored ``tree``.

    ``root_holds``: the stored leaves still give the root kept elsewhere, so ``state`` can be believed; without it the
    stored tree was changed too.
    """
    stored = tree.filter("level = 0").select(F.col("node").alias("chain"), F.col("digest").alias("was"))
    now = heads.select(F.col("chain").cast("long").alias("chain"), head_digest().alias("is"))
    again = stored.select(F.lit(0).alias("level"), F.col("chain").alias("node"), F.col("was").alias("digest"))
    depth = tree.agg(F.max("level")).first()[0] or 0
    for level in range(1, depth + 1):
        up = again.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(_family().alias("f"))
        again = up.select(F.lit(level).alias("level"), "node", _joint(F.col("f")).alias("digest"))
    kept_root = F.lit(kept_root) if isinstance(kept_root, str) else kept_root
    state = (F.when(F.col("is").isNull(), "chain_missing").when(F.col("was").isNull(), "chain_unknown")
             .when(F.col("is") != F.col("was"), "head_differs").otherwise("ok"))
    return stored.join(now, "chain", "full_outer").select(
        "chain", state.alias("state"),
        F.coalesce(again.agg(F.max("digest")).scalar() == kept_root, F.lit(False)).alias("root_holds"))
