"""Merkle trees against trees built by hand: odd runs, lone leaves, several rounds of blocks, nulls and repeats."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanweave.llm import merkle

COLUMNS = "doc_id long, text string, lang string, node string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def others(tree, slot, arity):
    found = []
    for level in tree[:-1]:
        first = slot // arity * arity
        found += [x for i, x in enumerate(level[first : first + arity], first) if i != slot]
        slot //= arity
    return found


def by_hand(rows, arity):
    groups = {}
    for doc, text, lang, *_ in rows:
        groups.setdefault("" if lang is None else "=" + lang, []).append((doc is not None, doc or 0, h(field(doc), field(text)), doc))
    trees = {k: (sorted(v, key=lambda x: x[:3]),) for k, v in groups.items()}
    trees = {k: (v[0], levels([x[2] for x in v[0]], arity)) for k, v in trees.items()}
    names = sorted(trees, key=lambda k: k.encode())
    top = levels([trees[k][1][-1][0] for k in names], arity)
    return sorted(
        (str(leaf[3]), leaf[2], tree[-1][0], top[-1][0], "".join(others(tree, slot, arity) + others(top, i, arity)))
        for i, k in enumerate(names)
        for leaves, tree in [trees[k]]
        for slot, leaf in enumerate(leaves)
    )


def rows_of(n):
    return [(i * 7 % n, f"tëxt {i}" if i % 5 else None, ["en", "fr", None, ""][i % 9 % 4], "own", i) for i in range(n)]


@pytest.mark.parametrize("n,arity,depth", [(1, 2, 1), (2, 2, 10), (37, 2, 1), (61, 2, 2), (40, 3, 2), (50, 2, 10)])
def test_trees_by_hand(spark, n, arity, depth):
    rows = rows_of(n)
    if n == 61:
        rows += [rows[3], rows[3], (None, None, "en", None, None), (None, "x" * 300_000, "single", None, None)]
    found = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(3), ["doc_id", "text"], "lang", "doc_id", arity, depth, doc_id=F.col("doc_id"))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof"), (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in got) == by_hand(rows, arity)


def test_tampered_leaves_do_not_verify(spark):
    found = merkle.manifest(spark.createDataFrame(rows_of(30), COLUMNS), ["doc_id", "text"], "lang", "doc_id", doc_id=F.col("doc_id"))
    wrong = merkle.fold(merkle.leaf(F.col("doc_id") + 1), F.col("path"))
    assert found.where(wrong == F.col("root")).count() == 0


def test_empty_and_bad_names(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert merkle.manifest(empty, ["text"], "lang", "doc_id", doc_id=F.col("doc_id")).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(empty, ["text"], "lang", "doc_id", path=F.col("text"))
