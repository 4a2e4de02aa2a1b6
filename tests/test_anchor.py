from pyspark.sql import functions as F

from casemesh.operators import anchor

HEADS = "chain BIGINT, first_seq BIGINT, last_seq BIGINT, rows BIGINT, head_hash STRING"


def heads(spark, chains, changed=()):
    rows = [(c, 64 * c, 64 * c + 63, 64, f"{'x' if c in changed else 'h'}{c}") for c in chains]
    return spark.createDataFrame(rows, HEADS)


def plain_root(rows):
    """The tree by plain loops over the sorted leaves."""
    import hashlib
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    nodes = {r.chain: sha(f"head|{r.chain}|{r.first_seq}|{r.last_seq}|{r.rows}|{r.head_hash}") for r in rows}
    while max(nodes) > 0:
        nodes = {up: sha("node|" + "|".join(f"{n}:{nodes[n]}" for n in sorted(nodes) if n >> 4 == up)) for up in {n >> 4 for n in nodes}}
    return nodes[0]


def test_one_root_binds_all_chains(spark):
    chains = [*range(0, 40), 300, 301, 5_000]
    whole = heads(spark, chains)
    tree = anchor.hash_tree(whole)
    root = tree.agg(F.max_by("digest", "level")).first()[0]
    assert root == plain_root(whole.collect())
    for other in (heads(spark, chains[1:]), heads(spark, chains, [301]), heads(spark, [*chains, 41])):
        assert anchor.hash_tree(other, 4).agg(F.max_by("digest", "level")).first()[0] != root
    states = {r.chain: r.state for r in anchor.check_tree(heads(spark, [*chains[1:], 41], [5]), tree, root).collect()}
    assert {c: s for c, s in states.items() if s != "ok"} == {0: "chain_missing", 5: "head_differs", 41: "chain_unknown"}
    assert all(r.root_holds for r in anchor.check_tree(whole, tree, root).collect())
    assert not any(r.root_holds for r in anchor.check_tree(heads(spark, chains, [5]), anchor.hash_tree(heads(spark, chains, [5])), root).collect())


def test_a_head_is_proved_by_its_path(spark):
    chains = [*range(0, 40), 300, 5_000]
    whole = heads(spark, chains)
    tree = anchor.hash_tree(whole)
    proofs = anchor.prove(tree, whole.filter("chain IN (0, 17, 5000)"))
    assert max(len(f) for r in proofs.collect() for f in r.proof) <= 16
    told = heads(spark, [0, 17, 300, 5_000], [17])
    got = {r.chain: r.proved for r in anchor.proved(told, proofs, anchor.root(tree)).collect()}
    assert got == {0: True, 17: False, 300: False, 5_000: True}


def test_one_chain_and_none(spark):
    one = anchor.hash_tree(heads(spark, [0]))
    assert [(r.level, r.node) for r in one.collect()] == [(0, 0)]
    assert anchor.proved(heads(spark, [0]), anchor.prove(one, heads(spark, [0])), anchor.root(one)).count() == 1
    assert anchor.hash_tree(heads(spark, [])).collect() == []
