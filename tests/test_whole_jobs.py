"""Registered queries cover their whole tables: results against plain Python over all rows of small tables."""

from collections import Counter

import pytest

import __spark_entry__

MARKER_NAMES = {1: "LOOP", 3: "IF_TRUE", 5: "BRANCH_END", 7: "LOOP_BACK", 12: "THROW"}
ROUND = {"LOOP", "LOOP_BACK", "THROW"}


def run(spark, small, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, small).collect()]


@pytest.fixture(scope="module")
def stored(spark, small):
    """Chains by function, names by symbol, and call records by (function, position)."""
    chains = {r["func_id"]: [int(x) for x in r["chain"].split(",")] for r in run(spark, small, "k1_chains")}
    names = {r["id"]: r["name"] for r in run(spark, small, "k1_symbols")}
    records = {(r["caller_id"], r["position"]): r for r in run(spark, small, "k1_call_records")}
    assert {i // 1_000_000 for i in chains} == {0, 1, 2, 10, 20, 40}
    return chains, names, records


def label(names, element):
    return MARKER_NAMES.get(element) or names[element]


def calls_of(chain):
    return [(p, e) for p, e in enumerate(chain) if p and e >= 100]


def simulated(chain, names, cap, if_true):
    """Tokens of a run: conditions hold or don't, loops go `cap` rounds, a throw ends it after the calls that follow."""

    def until(at, *ends):
        while at < len(chain) and chain[at] not in ends:
            at += 1
        return at

    out, at = [], 1
    while at < len(chain):
        e = chain[at]
        if e == 3:
            end = until(at, 5)
            out += [f"if:{int(if_true)}"] + [f"call:{names[x]}" for x in chain[at + 1 : end] if if_true]
            at = end + 1
        elif e == 1:
            end = until(at, 7)
            out += (["loop:1"] + [f"call:{names[x]}" for x in chain[at + 1 : end]]) * cap + ["loop:0"]
            at = end + 1
        elif e == 12:
            at += 1
            while at < len(chain) and chain[at] >= 100:
                out.append(f"call:{names[chain[at]]}")
                at += 1
            return out
        else:
            out.append(f"call:{names[e]}")
            at += 1
    return out


def mocks(chain, names, cap, if_true):
    return Counter(t[5:] for t in simulated(chain, names, cap, if_true) if t.startswith("call:"))


def test_guard_markers_of_all_chains(spark, small, stored):
    chains, _, _ = stored
    want = set()
    for i, chain in chains.items():
        for p, _ in calls_of(chain):
            start = p
            while start > 0 and chain[start - 1] < 100:
                start -= 1
            want.add((i, p, ",".join(MARKER_NAMES[x] for x in chain[start:p])))
    got = run(spark, small, "d5_guard_markers")
    assert len(got) == len(want) and {(r["func_id"], r["position"], r["guards"]) for r in got} == want


def test_flow_calls_of_all_chains(spark, small, stored):
    chains, names, records = stored
    want = {}
    for i, chain in chains.items():
        last = {e: p for p, e in calls_of(chain)}  # the edge tells of the last of equal calls
        for p, e in calls_of(chain):
            if e != i:
                edge, own = records.get((i, last[e])), records.get((i, p))
                pick = lambda k, none: next((r[k] for r in (edge, own) if r and r[k] is not None), none)  # noqa: B023, E731
                effect = edge["effect"] if edge else "none"
                loop = edge["is_loop_body"] if edge else False
                want[i, p] = (e, names[e], pick("condition", None), effect, own["line"] if own else 0, own["args"] if own else "", loop)
    got = run(spark, small, "g6_flow_calls")
    columns = ("to_id", "to_name", "condition", "effect", "line", "args", "is_loop_body")
    assert len(got) == len(want) and {(r["func_id"], r["position"]): tuple(r[c] for c in columns) for r in got} == want


def test_diagrams_of_all_chains(spark, small, stored):
    chains, names, _ = stored
    want = {}
    for i, chain in chains.items():
        lines = ["flowchart TD"]
        for p, e in enumerate(chain):
            text = label(names, e)
            left, right = ('(["', '"])') if e < 100 and text in ROUND else ('{"', '"}') if e < 100 else ('["', '"]')
            lines.append(f"  n{p}{left}{text}{right}")
        want[i] = "\n".join(lines + [f"  n{p - 1} --> n{p}" for p in range(1, len(chain))])
    assert {r["func_id"]: r["diagram"] for r in run(spark, small, "k8_flow_diagram")} == want


def test_all_chains_are_simulated(spark, small, stored):
    chains, names, _ = stored
    want = {i: t for i, chain in chains.items() if (t := simulated(chain, names, 10, True))}
    assert {r["func_id"]: r["sequence"] for r in run(spark, small, "b4_simulated_sequences")} == {i: ",".join(t) for i, t in want.items()}
    counts = {(i, name): n for i, chain in chains.items() for name, n in mocks(chain, names, 3, False).items()}
    assert {(r["func_id"], r["name"]): r["n"] for r in run(spark, small, "a11_mock_counts")} == counts
    delta = {(i, name) for i, chain in chains.items() for name in mocks(chain, names, 2, True).keys() - mocks(chain, names, 2, False).keys()}
    got = run(spark, small, "b8_policy_delta")
    assert len(got) == len(delta) and {(r["func_id"], r["name"]) for r in got} == delta


def test_k_means_of_all_vectors(spark, small):
    import numpy as np

    rows = sorted(spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect())
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    centroids = [x[0]]
    while len(centroids) < 4:
        centroids.append(x[np.max(x @ np.array(centroids).T, axis=1).argmin()])
    centroids, before = np.array(centroids), None
    for _ in range(10):
        cluster = (x @ centroids.T).argmax(1)
        if before is not None and (cluster == before).all():
            break
        before = cluster
        for k in set(cluster):
            mean = x[cluster == k].mean(0)
            centroids[k] = mean / np.linalg.norm(mean)
    want = Counter((x @ centroids.T).argmax(1).tolist())
    got = {r["cluster"]: r["n"] for r in run(spark, small, "v7_k_means")}
    assert got == want and sum(got.values()) == len(rows) == 500


def test_all_files_of_a_batch_are_seen(spark, tmp_path):
    folder = tmp_path / "tables"
    (folder / "t.parquet").mkdir(parents=True)
    names = {f"part-{i:04d}.parquet" for i in range(130)}
    for name in names:
        (folder / "t.parquet" / name).write_bytes(b"x")
    got = [r["name"] for r in run(spark, str(folder), "r9_watched_files")]
    assert len(got) == 130 and set(got) == names
