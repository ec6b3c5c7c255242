"""SimHash from the text to the class against plain code over all pairs, and its tiles against plain links."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemill.llm import queries, simhash
from tidemill.plans.components import stars

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, budget):
    """The smallest place that chains of links reach, for each place."""
    root = list(range(len(values)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    own = np.array(values, np.uint64)
    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= budget).tolist():
            a, b = sorted((of(i), of(i + 1 + j)))
            root[b] = a
    return [of(i) for i in range(len(own))]


def test_the_query_is_the_plain_method(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text, 3) for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, classes(prints, 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize(("budget", "crowd"), [(2, 0), (6, 0), (2, 250), (3, 250)])
def test_tiles_lose_no_link(spark, budget, crowd):
    rng = np.random.default_rng(budget)
    values = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)) for v in values]
    one = int(values[0])  # pages of one template: many fingerprints that share most bits, the evenest among them
    crowded = [one ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 12), replace=False)) for _ in range(crowd)]
    own = sorted({*values.tolist(), *near, *crowded})
    table = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in own], "fp long")
    found = stars(simhash.links(table, budget, tile=8)).collect()
    root = {r.node: r.root for r in found}
    by_root, by_class = defaultdict(set), defaultdict(set)
    for v, c in zip(own, classes(own, budget)):
        signed = v - (1 << 64) if v >= 1 << 63 else v
        by_class[c].add(v)
        by_root[root.get(signed, signed)].add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_class.values()))
    assert simhash.links(table.limit(1), budget).count() == 0


def test_masks():
    assert simhash._masks(4, 1) == [0, 1, 2, 4, 8] and len(simhash._masks(20, 3)) == 1 + 20 + 190 + 1140
