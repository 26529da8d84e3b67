"""SimHash near-duplicates by a self-join of the binary trie of the fingerprints.

A fingerprint has a bit for each of the 64 bits of the hashes of a text's word shingles,
set where it is set in more than half of them. Documents are linked where fingerprints
differ in at most ``DISTANCE`` bits, and their links followed to components.

Distinct fingerprints are the leaves of a binary trie. It is joined with itself: a pair of
nodes of equal depth, with the bits in which they differ so far, leads to the pairs of
their children, and a pair is dropped as soon as it differs in more bits than allowed.

- Near the root the pairs are rows, and ``STEP`` levels are one round of two small joins.
  A node stops being split when its subtree has at most ``LEAF`` fingerprints, so that a
  crowd of near copies becomes many deep nodes and never one large group.
- Pairs of such subtrees then go to tasks, which walk on bit by bit over ranges of the two
  sorted arrays, some node pairs at a time. A task gives the links of a forest that joins
  what it found, not every pair.

Copies share a fingerprint, which takes part once. A fingerprint has at most 2,080 others
within two bits, so the pairs met grow with the documents even among near copies.

Defined cases: a null text is empty; a text without words has fingerprint zero and is
linked like any other; a text with fewer words than a shingle is one shingle. Rows repeated
under one id are linked as any others. Rows without an id take part; their component is
the least id reached, null if there is none. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.llm.batches import map_rows
from carequeue.llm.components import settled
from carequeue.llm.hashed_words import TO_LOWER
from carequeue.operators.shared import written

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
STEP = 4  # levels of the trie that one round of joins goes down
LEAF = 1 << 14  # fingerprints of a subtree that a task walks through
PAIRS_AT_ONCE = 1 << 18  # node pairs a task holds of one level
BYTES_AT_ONCE = 1 << 20  # of a text
PAIRS_PER_TASK = 8

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a stretch of about a megabyte at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, min(at + BYTES_AT_ONCE, len(text)))
        stop = space.start() if space else len(text)
        yield text[at:stop].split()
        at = max(stop, at + 1)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces."""
    joined = b" ".join(words)
    after = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *after[: len(words) - size].tolist()]
    ends = (after[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True))
    return np.fromiter(found, np.uint64, len(ends))


def shingle_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, repeats included, in pieces."""
    last: list[bytes] = []
    whole = True
    for words in _words(text.encode().translate(TO_LOWER)):
        words = last + words
        if len(words) >= SHINGLE:
            whole = False
            yield _hashes(words, SHINGLE)
            words = words[1 - SHINGLE :]
        last = words
    if whole and last:
        yield _hashes(last, len(last))


def fingerprint(text: str) -> int:
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    set_bits = np.packbits(2 * ones > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each document, the fingerprint as a signed long."""

    def make():
        def work(texts):
            made = np.array([fingerprint(t) for t in texts], np.uint64)
            return [(x,) for x in made.view(np.int64).tolist()]

        return work

    return map_rows(docs.select("doc_id", "text"), make, "fingerprint long")


def _above(depth: int) -> int:
    """A signed long with the first ``depth`` of 64 bits set."""
    return -1 << (BITS - depth) if depth else 0


def _prefix(column: str, depth: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(_above(depth)).cast("long"))


def _rest(prefix: str, depth: int) -> list[Column]:
    return [F.lit(depth).alias("depth"), F.col(prefix).alias("prefix")]


def trie(values: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, list[DataFrame]]:
    """The bounded subtrees of a table of distinct values, and the nodes above them.

    Gives (depth, prefix, values) of each subtree, its sorted values as an array, and for
    each round of ``STEP`` levels a table (parent, prefix, is_leaf) of the nodes that the
    split nodes of the round before have. The first table holds the root.
    """
    rows = values.select("value").withColumns(
        {"prefix": F.lit(0).cast("long"), "parent": F.lit(0).cast("long")}
    )
    leaves, levels, depth = [], [], 0
    while True:
        sizes = rows.groupBy("prefix").agg(
            F.first("parent").alias("parent"), F.count("*").alias("n")
        )
        nodes = written(
            sizes.select("parent", "prefix", (F.col("n") <= leaf).alias("is_leaf")), "trie-nodes"
        )
        levels.append(nodes)
        split = nodes.where(~F.col("is_leaf")).select("prefix")
        if split.isEmpty():
            leaves.append(rows.select(*_rest("prefix", depth), "value"))
            break
        leaves.append(
            rows.join(split, "prefix", "left_anti").select(*_rest("prefix", depth), "value")
        )
        below = rows.join(split, "prefix", "left_semi")
        depth += STEP
        rows = written(
            below.select(
                "value",
                _prefix("value", depth).alias("prefix"),
                F.col("prefix").alias("parent"),
            ),
            "trie-rows",
        )
    every = leaves[0]
    for more in leaves[1:]:
        every = every.union(more)
    # at most ``leaf`` values in a group
    subtrees = every.groupBy("depth", "prefix").agg(
        F.sort_array(F.collect_list("value")).alias("values")
    )
    return written(subtrees, "trie-leaves"), levels


def _children(pairs: DataFrame, side: str, nodes: DataFrame, depth: int) -> DataFrame:
    """Replace the split nodes on one side by their nodes of ``depth``."""
    is_leaf, prefix = F.col(f"{side}_leaf"), F.col(f"{side}_prefix")
    stay = pairs.where(is_leaf)
    others = [c for c in pairs.columns if not c.startswith(f"{side}_")]
    below = nodes.select(
        F.col("parent").alias(f"{side}_of"),
        F.col("prefix").alias(f"{side}_prefix"),
        F.col("is_leaf").alias(f"{side}_leaf"),
        F.lit(depth).alias(f"{side}_depth"),
    )
    split = pairs.where(~is_leaf).select(*others, prefix.alias(f"{side}_of"))
    return split.join(below, f"{side}_of").drop(f"{side}_of").unionByName(stay)


def subtree_pairs(levels: list[DataFrame], distance: int = DISTANCE) -> DataFrame:
    """Pairs of bounded subtrees whose prefixes do not differ in more bits than allowed."""
    root = levels[0].select(
        *[
            column
            for side in "ab"
            for column in (
                F.col("prefix").alias(f"{side}_prefix"),
                F.col("is_leaf").alias(f"{side}_leaf"),
                F.lit(0).alias(f"{side}_depth"),
            )
        ]
    )
    both = F.col("a_leaf") & F.col("b_leaf")
    pairs, ended = root, [root.where(both)]
    for k, nodes in enumerate(levels[1:], 1):
        depth = STEP * k
        same = (F.col("a_prefix") == F.col("b_prefix")) & (F.col("a_depth") == F.col("b_depth"))
        open_ = pairs.where(~both).withColumn("same", same)
        children = _children(_children(open_, "a", nodes, depth), "b", nodes, depth)
        # a leaf may lie higher than what it is paired with: only common levels count
        errors = F.expr(
            f"bit_count(shiftrightunsigned(a_prefix ^ b_prefix, {BITS} - least(a_depth, b_depth)))"
        )
        kept = children.where(errors <= distance).where(
            ~F.col("same") | (F.col("a_prefix") <= F.col("b_prefix"))
        )
        pairs = written(kept.drop("same"), "trie-pairs")
        ended.append(pairs.where(both))
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return found.drop("a_leaf", "b_leaf")


def _halves(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range of values with equal higher bits those with the bit set begin."""
    first = values[lo] & ~np.uint64(2 * bit - 1) | np.uint64(bit)
    return np.clip(np.searchsorted(values, first), lo, hi)


def close_pairs(
    a: np.ndarray, b: np.ndarray, same: bool, distance: int = DISTANCE
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs in two sorted arrays of distinct values that differ in few bits.

    With ``same`` the arrays are one, and each pair is given once.
    """
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero + len(a), zero, zero + len(b), zero)]
    while stack:
        depth, alo, ahi, blo, bhi, errors = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            for part in (slice(half), slice(half, None)):
                stack.append((depth, *(x[part] for x in (alo, ahi, blo, bhi, errors))))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= distance
            if same:
                near &= i != j
            if near.any():
                yield i[near], j[near]
            keep = ~single
            alo, ahi, blo, bhi, errors = (x[keep] for x in (alo, ahi, blo, bhi, errors))
        if not len(alo):
            continue
        bit = 1 << (BITS - 1 - depth)
        amid, bmid = _halves(a, alo, ahi, bit), _halves(b, blo, bhi, bit)
        own = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        below = []
        for x, xlo, xhi in ((0, alo, amid), (1, amid, ahi)):
            for y, ylo, yhi in ((0, blo, bmid), (1, bmid, bhi)):
                more = errors + (x != y)
                keep = (xlo < xhi) & (ylo < yhi) & (more <= distance)
                if x > y:
                    keep &= ~own
                below.append([v[keep] for v in (xlo, xhi, ylo, yhi, more)])
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*below))))


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hook the trees of i and j together; every place then points to its root."""
    while True:
        ri, rj = root[i], root[j]
        apart = ri != rj
        if not apart.any():
            return
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, root) that join whatever ``close_pairs`` finds to be near."""
    values = a if same else np.concatenate([a, b])
    root = np.arange(len(values))
    for i, j in close_pairs(a, b, same):
        _join(root, i, j if same else j + len(a))
    hung = np.flatnonzero(root != np.arange(len(root)))
    return values[hung], values[root[hung]]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            a, b = (
                np.sort(one.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                for c in ("a_values", "b_values")
            )
            u, v = forest(a, b, one.column("same")[0].as_py())
            if len(u):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]
                )


def near_links(values: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Links (u, v) that join all values which differ in at most ``DISTANCE`` bits.

    ``values`` has distinct longs ``value``.
    """
    subtrees, levels = trie(values, leaf)
    pairs = written(subtree_pairs(levels), "trie-subtrees")

    def side(name: str) -> DataFrame:
        return subtrees.select(*[F.col(c).alias(f"{name}_{c}") for c in subtrees.columns])

    same = (F.col("a_prefix") == F.col("b_prefix")) & (F.col("a_depth") == F.col("b_depth"))
    tasks = max(1, -(-pairs.count() // PAIRS_PER_TASK))
    with_values = (
        pairs.join(side("a"), ["a_depth", "a_prefix"])
        .join(side("b"), ["b_depth", "b_prefix"])
        .withColumn("same", same)
    )
    # each pair of subtrees costs much and weighs little, so they are dealt out evenly
    spread = with_values.repartition(tasks, "a_depth", "a_prefix", "b_depth", "b_prefix")
    return spread.select("a_values", "b_values", "same").mapInArrow(_walk, "u long, v long")


def simhash_groups(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    rows = written(fingerprints(docs), "simhash")
    values = written(
        rows.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least")),
        "simhash-values",
    )
    links = settled(near_links(values, leaf))
    label = F.coalesce("v", "value").alias("label")
    labelled = written(
        values.join(links, F.col("value") == F.col("u"), "left").select("value", "least", label),
        "simhash-labels",
    )
    # only components of several fingerprints need the least id of all of them
    joined = links.select(F.col("v").alias("label")).distinct()
    least = (
        labelled.join(joined, "label", "left_semi")
        .groupBy("label")
        .agg(F.min("least").alias("of_all"))
    )
    components = labelled.join(least, "label", "left").select(
        F.col("value").alias("fingerprint"),
        F.when(F.col("of_all").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("component_id"),
    )
    return rows.join(written(components, "simhash-components"), "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component_id").cast("long"),
    )
