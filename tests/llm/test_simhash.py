"""SimHash fingerprints and their trie self-join against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from carequeue.llm import simhash
from carequeue.llm.components import components
from carequeue.llm.registry import LLM_QUERIES

SCHEMA = "doc_id long, text string, value long, prefix int, component_id string"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if words and not shingles:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Component of each row, by comparing all pairs."""
    prints = [plain_fingerprint(text) for _, text in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return sorted(
        ((d, f"{p:016x}", least.get(x)) for (d, _), p, x in zip(rows, prints, label)), key=repr
    )


def awkward_rows(rng):
    words = ["alpha", "Beta", "GAMMA", "déjà", "über", "中文", "x", "..."]
    text = [rng.choice(words) for _ in range(400)]
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "one two"),
        (7, "a b c\x0bd e"), (None, "one two"), (None, "nothing like it at all here"),
        (8, "repeated id"), (8, "another text under the id"), (4, "one"),
    ]
    for i in range(20, 60):
        copy = list(text)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(60)]
    rows.append((200, "long " * 300_000 + "end"))
    return rows


@pytest.mark.parametrize("leaf", [simhash.LEAF, 60])
def test_groups_equal_all_pairs(spark, leaf):
    rows = awkward_rows(random.Random(11))
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    found = simhash.simhash_groups(df, leaf)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_groups(rows)


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def clusters(rng, n, size):
    """Values around common centres, many of them within two bits of each other."""
    found = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    return np.array(sorted(found), np.uint64)


def all_pairs(a, b):
    return {
        (i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= 2)
    }


def test_walk_finds_exactly_the_close_pairs(monkeypatch):
    rng = random.Random(2)
    a, b = clusters(rng, 8, 60), clusters(rng, 8, 60)
    b = np.unique(np.concatenate([b, a[::3] ^ np.uint64(5), a[::7]]))
    for at_once in (simhash.PAIRS_AT_ONCE, 16):
        monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
        found = [p for i, j in simhash.close_pairs(a, b, False) for p in zip(i.tolist(), j.tolist())]
        assert len(found) == len(set(found)) and set(found) == all_pairs(a, b)
        own = [p for i, j in simhash.close_pairs(a, a, True) for p in zip(i.tolist(), j.tolist())]
        assert len({frozenset(p) for p in own}) == len(own)
        assert {tuple(sorted(p)) for p in own} == {p for p in all_pairs(a, a) if p[0] < p[1]}


@pytest.mark.parametrize("leaf", [1 << 14, 150])
def test_links_of_clusters_in_subtrees_of_unlike_depth(spark, leaf):
    values = clusters(random.Random(5), 6, 120)
    signed = values.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "value long")
    found = dict(map(tuple, components(simhash.near_links(df, leaf)).collect()))
    label = list(range(len(values)))
    for i, j in all_pairs(values, values):
        if label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    both = {(found.get(s, s), x) for s, x in zip(signed, label)}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})


def test_query_equals_all_pairs_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = LLM_QUERIES["op11_simhash"](spark, folder).collect()
    assert sorted(map(tuple, found), key=repr) == plain_groups([tuple(r) for r in rows])
