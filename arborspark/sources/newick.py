"""Newick trees as rows: tree_id, newick, and edges (u, v, z) with tips numbered by name."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:\[[^\]]*\]\s*)*('(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+)")

Tree = list[tuple[int, int, float]]  #: edges (u, v, z): tips 0 to n-1, inner nodes after


def parse(newick: str, tips: dict[str, int], lengths: bool = False) -> Tree:
    """Edges of an unrooted binary tree. Branch lengths are left out unless `lengths`; a root with
    two children is dissolved; every tip must occur exactly once."""
    start, edges, stack, at, node, seen = 0.9, [], [], 0, len(tips), []
    last, after_colon = None, False
    children: dict[int, list[list]] = {}
    tokens = [t.replace("''", "'") for t in TOKEN.findall(newick)]
    for i, t in enumerate(tokens):
        if t == "(":
            stack.append(node)
            children[node] = []
            node += 1
        elif t == ")":
            last = [stack.pop(), start]
            (children[stack[-1]].append(last) if stack else None)
        elif t == ":":
            after_colon = True
        elif t == ";":
            break
        elif t != ",":
            if after_colon:
                if lengths and last:
                    last[1] = math.exp(-float(t))
                after_colon = False
            elif tokens[i - 1] != ")":
                name = t.strip("'")
                if name not in tips:
                    raise ValueError(f"unknown taxon {name!r}")
                last = [tips[name], start]
                seen.append(name)
                children[stack[-1]].append(last)
    if stack or sorted(seen) != sorted(tips):
        raise ValueError("parentheses don't match, or a taxon is missing or twice in the tree")
    root = len(tips)
    if len(children[root]) == 2:
        (a, za), (b, zb) = children.pop(root)
        join = [(a, b, za * zb if lengths else start)]
        if a < len(tips):
            a, b = b, a
    else:
        join, a = [], root
    for parent, below in children.items():
        edges += [(parent, c, z) for c, z in below]
    edges += join
    if any(len(x) != (3 if p == root else 2) for p, x in children.items()):
        raise ValueError("the tree is not binary")
    names = {n: i for i, n in enumerate(sorted({x for e in edges for x in e[:2] if x >= len(tips)}), len(tips))}
    return [(names.get(u, u), names.get(v, v), z) for u, v, z in edges]


def constraint_splits(newick: str, tips: dict[str, int]) -> frozenset[frozenset[int]]:
    """The inner splits of a tree of all tips that need not be binary: tips of the side without tip 0."""
    stack: list[set[int]] = []
    found, seen, skip, after = [], [], False, ""
    for t in TOKEN.findall(newick):
        if t == "(":
            stack.append(set())
        elif t == ")":
            done = stack.pop()
            found.append(done)
            if stack:
                stack[-1] |= done
        elif t == ":":
            skip = True
        elif t == ";":
            break
        elif t != ",":
            if not skip and after != ")":
                name = t.strip("'").replace("''", "'")
                if name not in tips:
                    raise ValueError(f"unknown taxon {name!r}")
                seen.append(tips[name])
                stack[-1].add(tips[name])
            skip = False
        after = t
    if stack or sorted(seen) != sorted(tips.values()):
        raise ValueError("parentheses don't match, or a taxon is missing or twice in the tree")
    every = frozenset(seen)
    sides = (every - x if 0 in x else frozenset(x) for x in found)
    return frozenset(x for x in sides if 2 <= len(x) <= len(every) - 2)


def resolved(newick: str, names: list[str], seed: int) -> str:
    """A random binary tree with all splits of a tree that need not be binary; lengths are left out.
    Children of a node are joined two by two at random until two are left, three at the root."""
    tips, rng, stack, after, skip = {n: i for i, n in enumerate(names)}, random.Random(seed), [[]], "", False
    quoted = lambda n: n if re.fullmatch(r"[^\s(),:;\[\]']+", n) else "'" + n.replace("'", "''") + "'"

    def joined(parts: list[str], most: int) -> str:
        parts = list(parts)
        while len(parts) > most:
            a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
            parts.append(f"({a},{b})")
        return parts[0] if len(parts) == 1 else "(" + ",".join(parts) + ")"

    for t in TOKEN.findall(newick):
        if t == "(":
            stack.append([])
        elif t == ")":
            parts = stack.pop()
            stack[-1].append(joined(parts, 3 if len(stack) == 1 else 2))
        elif t == ":":
            skip = True
        elif t == ";":
            break
        elif t != ",":
            if not skip and after != ")":
                stack[-1].append(quoted(t.strip("'").replace("''", "'")))
            skip = False
        after = t
    out = stack[0][0] + ";"
    parse(out, tips)
    return out


def neighbours(tree: Tree) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for u, v, z in tree:
        out.setdefault(u, {})[v] = z
        out.setdefault(v, {})[u] = z
    return out


def regraft(tree: Tree, node: int, cut: int, a: int, b: int) -> Tree:
    """The tree with the subtree behind node, cut off at `cut`, put into the middle of edge a-b."""
    near = neighbours(tree)
    p, q = (x for x in near[cut] if x != node)
    joined = near[cut][p] * near[cut][q]
    kept = [(u, v, z) for u, v, z in tree if {u, v} not in ({cut, p}, {cut, q}, {a, b})]
    half = near[a][b] ** 0.5
    if {a, b} == {p, q}:
        return tree
    return [*kept, (p, q, joined), (cut, a, half), (cut, b, half)]


def write(tree: Tree, names: list[str], lengths: bool = True) -> str:
    """Canonical text: rooted at the inner node next to tip 0, children by their smallest tip."""
    near = neighbours(tree)
    root = next(iter(near[0]))
    order, above = [root], {root: -1}
    for n in order:
        for c in near[n]:
            if c != above[n]:
                above[c] = n
                order.append(c)
    # joined from the tips on, without recursion: the least tip and the text of what is below
    text: dict[int, tuple[int, str]] = {}
    for n in reversed(order):
        tail = f":{-math.log(near[n][above[n]]):.10f}" if lengths and n != root else ""
        if n < len(names):
            text[n] = n, names[n] + tail
            continue
        below = sorted(text.pop(c) for c in near[n] if c != above[n])
        text[n] = below[0][0], "(" + ",".join(t for _, t in below) + ")" + tail
    return text[root][1] + ";"


def tip_sets(tree: Tree, n_tips: int) -> set[frozenset[int]]:
    """The inner splits of a tree: tips of the side without tip 0."""
    near = neighbours(tree)
    order, above = [0], {0: -1}
    for n in order:
        for c in near[n]:
            if c != above[n]:
                above[c] = n
                order.append(c)
    under = {n: {n} if n < n_tips else set() for n in order}
    for n in reversed(order[1:]):
        under[above[n]] |= under[n]
    return {frozenset(under[n]) for n in order[1:] if n >= n_tips and 2 <= len(under[n]) <= n_tips - 2}


def topology(tree: Tree, n_tips: int) -> str:
    """The same text for the same inner splits, whatever the lengths and the numbers of inner nodes: a digest of fixed size."""
    text = "|".join(sorted(",".join(map(str, sorted(x))) for x in tip_sets(tree, n_tips)))
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Trees of text files, split at `;`: tree_id (in the order of the text), newick."""
    rows = spark.read.option("lineSep", ";").text(path).select(F.monotonically_increasing_id().alias("tree_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("newick"))
    return rows.where("newick <> ''").select("tree_id", F.concat("newick", F.lit(";")).alias("newick"))


def to_edges(trees: DataFrame, names: list[str], lengths: bool = False) -> DataFrame:
    """tree_id, edges."""
    tips = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edges = [[{"u": u, "v": v, "z": z} for u, v, z in parse(t, tips, lengths)] for t in b["newick"]]
            yield pd.DataFrame({"tree_id": b["tree_id"], "edges": edges})

    return trees.mapInPandas(run, "tree_id long, edges array<struct<u:int,v:int,z:double>>")


def splits(trees: DataFrame, names: list[str]) -> DataFrame:
    """Inner splits of each tree: tree_id, split (tips of the side without tip 0, ascending)."""
    tips = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(tree_id, sorted(x)) for tree_id, text in zip(b["tree_id"], b["newick"]) for x in tip_sets(parse(text, tips), len(names))]
            yield pd.DataFrame(rows, columns=["tree_id", "split"])

    return trees.mapInPandas(run, "tree_id long, split array<int>")
