import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import LOWER
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.jaccard_join import jaccard_classes
from graphloom.llm.signature_tree import links
from graphloom.llm.substring_dedup import substring_dedup
from graphloom.llm.suffix_dedup import _Chunk, _few_parts, _parts, suffix_dedup
from graphloom.llm.suffix_sort import common_prefix_reaches, sort_keys, two_stage_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("window, per_chunk", [(35, 1 << 20), (35, 5000), (4, 20_000)])
def test_substring_dedup(docs, rows, window, per_chunk):
    words = [WORD.findall(t or "") for _, t in rows]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for j in range(window)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring_dedup(docs, window, chunk_bytes=per_chunk).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(x[2] for x in want)


def test_substring_dedup_of_nothing(none):
    assert substring_dedup(none).collect() == []


@pytest.mark.parametrize("per_chunk, hot", [(1 << 20, 1 << 14), (10_000, 5)])
def test_suffix_dedup(docs, rows, per_chunk, hot, monkeypatch):
    monkeypatch.setattr("graphloom.llm.suffix_dedup._PLACE", np.uint64((1 << (28 if hot > 5 else 10)) - 1))  # places far beyond the mask's range
    first: dict[bytes, float] = {}
    raw = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], float("inf")), i)
    want = []
    for (i, _), (order, b) in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order:
                gone[k : k + 50] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    got = suffix_dedup(docs, chunk_bytes=per_chunk, hot_segments=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_suffix_dedup_around_one_anchor(spark):
    """Some hundred segments of one chunk around the same bytes: more than one byte counts."""
    r = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    word = lambda n: r.choice(letters, n).tobytes()
    core = word(30)
    texts = [word(int(r.integers(5, 18))) + core + word(int(r.integers(5, 18))) for _ in range(500)]
    texts += [texts[7] + b" " + word(60), word(60) + texts[9], *texts[20:24]]
    first: dict[bytes, int] = {}
    for i, b in enumerate(texts):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = {}
    for i, b in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        want[i] = int(gone.sum())
    docs = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(texts)], "doc_id long, text string")
    assert sum(want.values()) > 100
    for hot in (300, 1 << 14):
        got = {row.doc_id: row.n_removed for row in suffix_dedup(docs, hot_segments=hot).collect()}
        assert got == want


def test_anchors_of_suffix_dedup():
    """Half a window is common wherever anchors are; they crowd in no bucket."""
    r = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    word = lambda n: r.choice(letters, n).tobytes().decode()
    common = [word(28) for _ in range(150)]
    texts = ["".join(word(30) + c for c in r.permutation(common)) + word(40) for _ in range(4)]
    texts.append(word(10) + texts[0][1000:1300])
    none = pa.table({"id": pa.array([], pa.int64()), "th": pa.array([], pa.int64())})
    found = [_Chunk(pa.table({"id": [k], "text": [t], "th": [k]}), none, 50) for k, t in enumerate(texts)]
    for a, c in enumerate(found):
        for b, d in enumerate(found[:a]):
            assert bool(set(c.anchor.tolist()) & set(d.anchor.tolist())) == ((a, b) == (4, 0))
    anchor_of = [{texts[k][w : w + 50]: x for f, z, x in zip(c.first, c.last, c.anchor, strict=True) for w in range(f, z + 1)} for k, c in enumerate(found)]
    both = anchor_of[0].keys() & anchor_of[4].keys()
    assert len(both) == 251 and all(anchor_of[0][w] == anchor_of[4][w] for w in both)
    values = np.sort(np.concatenate([c.anchor for c in found]))
    n = np.histogram((values >> np.uint64(56)).astype(int), 16, (0, 256))[0]
    assert n.max() < 2 * n.min()
    parts = _parts(values, 3).astype(int)
    assert len(set(parts[values < (1 << 64) // 3])) > 200 and parts.max() == 255 and (np.diff(parts) < 0).sum() == 2


def test_parts_that_are_sorted_at_once():
    assert _few_parts(np.array([0, 3, 4, 0, 9, 1, 0, 2]), 7) == [(1, 3), (4, 5), (5, 8)]
    assert _few_parts(np.zeros(4), 7) == []


@pytest.mark.parametrize("most", [1, 3000])
def test_suffix_dedup_sorts_a_few_parts_at_once(docs, most, monkeypatch):
    want = sorted(map(tuple, suffix_dedup(docs).select("doc_id", "n_removed", "n_spans").collect()), key=repr)
    monkeypatch.setattr("graphloom.llm.suffix_dedup.SORT_BYTES", most)
    assert sorted(map(tuple, suffix_dedup(docs).select("doc_id", "n_removed", "n_spans").collect()), key=repr) == want


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup(none).collect() == []


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        parts = [rng.integers(1, rng.choice([2, 3, 5, 256]) + 1, rng.integers(1, 40)) for _ in range(rng.integers(1, 12))]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        depth, keys = int(rng.choice([7, 10, 20])), sort_keys(text)
        order = two_stage_order(text, keys, depth)
        heads = [text[i : i + depth].tolist() for i in order]
        heads = [h[: h.index(0) + 1] if 0 in h else h for h in heads]
        assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
        whole = [k for k, h in enumerate(heads) if 0 not in h and len(h) == depth]
        same = common_prefix_reaches(order[whole], text, keys, depth)
        assert same.tolist() == [k > 0 and heads[whole[k]] == heads[whole[k - 1]] for k in range(len(whole))]


def classes(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j, both = rows[b][0], len(sets[a] & sets[b])
            if both and i is not None and j is not None and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("k, num, block, per_chunk", [(3, 90, 4096, 1 << 20), (5, 80, 3, 15_000)])
def test_jaccard_classes(docs, rows, k, num, block, per_chunk):
    got = [tuple(r) for r in jaccard_classes(docs, k, num, 100, chunk_bytes=per_chunk, block=block).collect()]
    assert sorted(got, key=repr) == sorted(classes(rows, k, num, 100), key=repr)


def test_jaccard_classes_of_nothing(none):
    assert jaccard_classes(none).collect() == []


def test_signature_tree_finds_every_class():
    rng = np.random.default_rng(2)
    base = [rng.choice(5000, 100, replace=False) for _ in range(10)]
    sets = [np.unique(np.concatenate([b[: 100 - e], rng.choice(10**6, e)])).astype(np.uint64) for b in base for e in rng.integers(0, 12, 20)]
    ids = np.arange(len(sets))
    found = links((ids, sets, ids), None, 90, 100)
    up = defaultdict(set)
    for a, b in found:
        assert len(np.intersect1d(sets[a], sets[b])) * 100 >= 90 * len(np.union1d(sets[a], sets[b]))
        up[a].add(b)
        up[b].add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in up[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b])):
                assert b in reach(a)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
