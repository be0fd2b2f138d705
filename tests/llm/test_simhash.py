import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import simhash
from treeline.llm.components import components
from treeline.llm.queries import op3_simhash_groups


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    """fps: list of (doc_id, fp)."""
    own = list(range(len(fps)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2 and find(i) != find(j):
                own[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f, least.get(find(i))) for i, (d, f) in enumerate(fps))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").collect()
    got = op3_simhash_groups(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    want = brute_components([(d, brute_fp(t)) for d, t in docs])
    assert sorted((str(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in got) == want
    assert any(d != str(c) for d, _, c in want)


def test_awkward_rows(spark):
    rows = [(4, None), (2, ""), (9, " \n"), (5, "One"), (6, "one"), (7, "É a"), (8, "é a"), (1, "w x y z " * 9000), (3, "W x y z " * 9000), (3, "W x y z " * 9000), (None, "lone text here"), (None, "one")]
    docs = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark, docs).collect())
    assert got == brute_components([(d, brute_fp(t)) for d, t in rows])
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "7", "8", "None"])
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def near_cloud(rng, centres, size):
    out = set()
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            for _ in range(rng.randrange(3)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_links_over_buckets_and_hot_buckets(spark, monkeypatch):
    rng = random.Random(3)
    fps = near_cloud(rng, 12, 60) + [rng.getrandbits(64) for _ in range(200)]
    fps += [(0xABC << 52) | rng.getrandbits(30) << 22 | 0x1234 for _ in range(400)]  # one bucket holds many
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in set(fps)], "fp long")
    want = brute_components([(x, x) for x in sorted(set(fps))])
    for hot in (4096, 50):
        monkeypatch.setattr(simhash, "HOT", hot)
        groups = {}
        for r in simhash.link_components(spark, df).collect():
            groups.setdefault(r.root, set()).add(r.fp % 2**64)
            groups[r.root].add(r.root % 2**64)
        least = {x: min(g) for g in groups.values() for x in g}
        assert sorted((str(x), x, least.get(x, x)) for x in set(fps)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20 - 1), min_size=2, max_size=300, unique=True), st.integers(1, 4))
def test_index_finds_exactly_the_near_pairs(values, buckets):
    fps = np.array(sorted(values), np.uint64)
    keys = np.sort(np.arange(len(fps)) % buckets)
    index = simhash.GrayIndex(keys, fps)
    found = {frozenset((int(index.fps[a]), int(index.fps[b]))) for x, y in index.links(2, 512) for a, b in zip(x, y)}
    want = {frozenset((int(fps[i]), int(fps[j]))) for i in range(len(fps)) for j in range(i) if keys[i] == keys[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert found == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    groups = {}
    for r in components(spark, edges).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 301]


def test_keep_one_keeps_rows_not_ids(spark):
    a, b = "one text of some words here", "quite another text than that one"
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (None, "third of them all")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _kept_id int, _row int")
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, a), (5, b), (None, "third of them all")]))
