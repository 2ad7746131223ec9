"""Near-duplicates and nearest neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomgraph.llm import ann, queries, simhash
from tests.llm.cases import ROWS, empty, table


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    """Index of the smallest member of each value's component, by comparing all pairs."""
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def brute(docs, radius=3):
    values = [plain_fingerprint(t) for _, t in docs]
    root = components(values, radius)
    low = {}
    for r, (i, _) in zip(root, docs, strict=True):
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return Counter((i, f"{v:016x}", low[r]) for (i, _), v, r in zip(docs, values, root, strict=True))


def test_edges_of_the_operator(spark):
    got = Counter(map(tuple, simhash.near_duplicates(table(spark)).collect()))
    docs = [(r[0], r[1]) for r in ROWS if r[0] != 6]
    want = brute(docs)
    for row in [r for r in got if r[0] == 6]:
        assert int(row[1], 16) == simhash.simhash(ROWS[6][1], part_chars=100)
        del got[row]
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_in_parts_is_the_whole():
    text = " ".join(random.Random(2).choice("alpha Beta gamma\n delta ÄB".split(" ")) for _ in range(400))
    assert simhash.simhash(text) == simhash.simhash(text, part_chars=50) == plain_fingerprint(text)


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op10_simhash_near_duplicates(spark, small).collect())) == brute(docs)


def clouds(seed, n):
    """Fingerprints in clouds whose neighbours differ in a few bits, with chains that leave the radius."""
    r = random.Random(seed)
    found = set()
    while len(found) < n:
        value = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 2, 30))):
            found.add(value)
            for _ in range(r.randint(1, 4)):
                value ^= 1 << r.randrange(64)
    return sorted(found)


def test_keys_hold_the_chosen_blocks(spark):
    from pyspark.sql import functions as F

    r = random.Random(20)
    for radius, blocks in ((3, 4), (3, 5), (3, 6), (3, 7), (1, 2), (0, 1)):
        values = [r.getrandbits(64) for _ in range(50)]
        values += [v ^ sum(1 << b for b in r.sample(range(64), radius)) for v in values]
        signed = [v - (1 << 64) if v >> 63 else v for v in values]
        rows = spark.createDataFrame([(v,) for v in signed], "fp long").select("fp", simhash.bucket_keys(F.col("fp"), radius, blocks).alias("k")).collect()
        keys = {x.fp: set(x.k) for x in rows}
        assert all(keys[a] & keys[b] for a, b in zip(signed[:50], signed[50:], strict=True))
    assert [simhash.blocks_for(n, 3) for n in (0, 1 << 20, 1 << 27, 1 << 33, 1 << 50)] == [4, 4, 5, 6, 7]


@pytest.mark.parametrize(("tile", "small", "blocks"), [(4096, 48, None), (4, 48, 4), (16, 2, 5), (4, 48, 6), (4096, 2, 7)])
def test_links_lose_nothing(spark, monkeypatch, tile, small, blocks):
    monkeypatch.setattr(simhash, "SMALL", small)
    values = clouds(tile, 600) + [0, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.connect(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=tile, blocks=blocks)).collect()
    parent = {r.u: r.v for r in found}
    groups = {}
    for v, root in zip(signed, components(values, 3), strict=True):
        groups.setdefault(root, []).append(v)
    for members in groups.values():
        low = min(members)
        assert all(parent.get(m, m) == low for m in members)


def test_connect_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(40)]
    hub = [(i, 100) for i in range(101, 160)]
    rows = simhash.connect(spark.createDataFrame([*chain, *hub, (300, 299), (300, 299)], "u long, v long")).collect()
    assert {(r.u, r.v) for r in rows} == {*((i, 0) for i in range(1, 41)), *((i, 100) for i in range(101, 160)), (300, 299)}


def test_one_of_each(spark):
    docs = table(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, None, 6, 8, 9, 10])


def test_one_of_each_with_ids_of_any_type(spark):
    schema = "doc_id string, text string, lang string, n_chars map<string, int>, row_hash int"
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "last"]), " ".join(reversed(words))
    assert components([plain_fingerprint(t) for t in (one, near, other)], 3)[2] == 2
    linked = components([plain_fingerprint(t) for t in (one, near)], 3) == [0, 0]
    rows = [("b", one, "x", None, 1), ("a", near, "x", {"k": 1}, 2), ("a", other, "y", None, 3), ("a", other, "y", None, 3), ("a", other, "z", None, 3), (None, "alone here", "x", None, 4)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang", "n_chars", "row_hash"]
    found = kept.collect()
    texts = Counter(r.text for r in found)
    assert texts[other] == 1 and texts["alone here"] == 1 and texts[near] == 1 and texts[one] == (0 if linked else 1)


def test_one_of_each_under_a_hot_row(spark):
    rows = [(7, "the same row " * 20)] * 3000 + [(i, f"text number {i} " * 3 + str(i * i)) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(t for _, t in {min((i, t) for (i, t), root in zip(set(rows), components([plain_fingerprint(t) for _, t in set(rows)], 3), strict=True) if root == k) for k in set(components([plain_fingerprint(t) for _, t in set(rows)], 3))})
    assert Counter(r.text for r in simhash.one_of_each(docs).collect()) == want


def plain_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, a in good:
        if q % 50 == 0 and q not in out:
            scored = sorted((-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), i) for i, b in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows)
    got = {}
    for r in queries.op7_anisotropic_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        for i, score in found:
            a, b = exact[q], exact[i]
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_neighbours_of_odd_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (50, [0.0, 2.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [3.0, 3.0, 0.0]), (100, None), (4, [0.0, 0.0, 0.0]),
        (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (150, [1e30, 1e30, 1e30]), (9, [-1.0, 0.0, 1e-30]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, vector string")
    got = ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[0] == [1, 2, 3, 150, 50]
    assert found[50] == [1, 2, 3, 150, 0]
    assert set(found) == {0, 50, 150}
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_hot_vector_keeps_ties_whole(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    hot = r.normal(size=16).tolist()
    rows = [(i, hot if i % 3 else r.normal(size=16).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 50 == 0, tile=256).collect()
    for q in (50, 100, 1000):
        mine = sorted((x.rank, x.vec_id) for x in got if x.query_id == q)
        assert [i for _, i in mine] == [1, 2, 4, 5, 7]


def test_repeated_ids(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    own = r.normal(size=16)
    rows = [(50, (own + r.normal(size=16) * 0.01).tolist()) for _ in range(20_000)]
    rows += [(1, own.tolist())] * 3 + [(7, own.tolist())] * 20 + [(i, r.normal(size=16).tolist()) for i in range(1000, 1300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    assert sorted((x.rank, x.vec_id) for x in got if x.query_id == 50) == [(1, 1), (2, 1), (3, 1), (4, 7), (5, 7)]


def test_the_grid_has_codes_of_rows_and_no_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    plan = ann.nearest(df, F.col("id") % 50 == 0)._jdf.queryExecution().optimizedPlan().toString()
    grid = [line for line in plan.splitlines() if "Project" in line and "AS query_tile" in line or "query_tile" in line and "codes" in line and "Project" in line]
    assert any("codes" in line and "null AS vector" in line for line in grid)
