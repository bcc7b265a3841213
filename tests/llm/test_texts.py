import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import LOWER
from pyspark.sql import functions as F

from graphloom.llm import lm_score as lm
from graphloom.llm.decontaminate import _blocks, contamination
from graphloom.llm.exchange import pack_counts, pack_keys, unpack_counts, unpack_keys
from graphloom.llm.language_id import Lattice, language_id, learn, long_word, op7_language_id
from graphloom.llm.lm_score import lm_score
from graphloom.llm.packing import between_ranges, pack, token_pieces
from graphloom.llm.quality import passing, quality_rules
from graphloom.llm.token_counts import EDITS, CountTree, cleaning_edits, count_trees, edit_trees, load_encoding, token_counts, usable, with_cleaning_edits
from graphloom.llm.tokens import WordEncoder
from graphloom.llm.url_filter import BLOCK_FROM, RULES, fit, scores, url_filter
from graphloom.llm.url_seed import is_held_out, seed_rows, seed_table
from graphloom.llm.words import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_repr(x):
    return sorted(map(tuple, x), key=repr)


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_contamination(spark, docs, rows, block_words):
    items = [(1, rows[0][1]), (2, "the"), (3, None), (4, "!!"), (10, (rows[2][1] or "")[:200]), (None, "x"), (11, "a b c a b c a b c a b c a b")]
    bench = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, n_words int")
    want = []
    owners: dict[tuple, set] = {}
    for i, t in items:
        w = FOLDED.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            owners.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for i, t in rows:
        w = FOLDED.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if own := owners.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    got = contamination(docs, bench, block_words=block_words).collect()
    assert by_repr(got) == by_repr(want)
    assert contamination(docs.where("1 = 0"), bench).collect() == []
    assert not any(r["n_hit"] for r in contamination(docs, bench.where("1 = 0")).collect())
    words = bench.where("item_id IN (2, 10)")
    assert [len(b) for b in _blocks(words, "item_id", "text", 1)] == [1, 1] and [len(b) for b in _blocks(bench.where("1 = 0"), "item_id", "text", 1)] == [0]


def test_quality(docs, rows):
    want = []
    for i, t in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed))
    got = quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_repr(got.collect()) == by_repr(want)
    assert passing(docs).count() == quality_rules(docs).where("kept").count() and passing(docs).columns == docs.columns
    assert quality_rules(docs.where("1 = 0")).collect() == []


def test_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://A.Org", "http://a.ORG/?x=/", "https://example.org/es/9", "http://b.example.org/en/12#a?b", "ftp://u@com:80/fr/", "http://com/fr/x", "http://z.com/de/", "http://xcom/de/", "http://casino-win.net/a", "http://library.net/catalog", "http://a.b://c/d"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id int, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filter(pages, seed_table(spark)).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            host, tail = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host, path = host.translate(LOWER), tail
        fits = [(len(r), r, v) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert got[k]["verdict"] == max(fits)[2]
    assert got[12]["verdict"] == "block" and got[13]["verdict"] == "allow"
    assert fit([])[-1] < 0
    assert url_filter(pages.where("1 = 0"), seed_table(spark).where("1 = 0")).collect() == []


def test_url_classifier_on_rows_held_out():
    split = [[], []]
    for url, label in seed_rows():
        host, _, path = url.removeprefix("http://").partition("/")
        split[is_held_out(url)].append((host, "/" + path if path else "", label))
    taught, held = split
    weights = fit(taught)
    found = scores([h for h, _, _ in held], [p for _, p, _ in held], weights) >= BLOCK_FROM
    right = np.array([y for _, _, y in held], bool)
    assert len(held) > 50 and (found & right).sum() >= 0.95 * found.sum() and (found & right).sum() >= 0.9 * right.sum()
    one = [scores([h], [p], weights)[0] for h, p, _ in held]
    assert np.allclose(one, scores([h for h, _, _ in held], [p for _, p, _ in held], weights))
    assert len(scores([], [], weights)) == 0


def test_urls_repeat(spark):
    pages = spark.createDataFrame([(1, "http://casino.test/"), (1, "http://casino.test/"), (None, None)], "page_id int, url string")
    got = by_repr(url_filter(pages, seed_table(spark)).drop("score").collect())
    assert got == [(1, "casino.test", "/", None, "block")] * 2 + [(None, "", "", None, "allow")]


def test_token_counts(spark, rows):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = load_encoding(ranks, pattern)
    import random

    r = random.Random(1)
    data = []
    for i, t in rows:
        n = len(t or "")
        edits = [(a, min(n, a + r.choice((0, 1, 5, 400))), r.choice(("", " ", "x", "'s", " ab ", "\n"))) for a in (r.randint(0, n) for _ in range(r.randint(0, 6)))]
        data.append((i, t, [*edits, (n + 5, n + 6, "out"), (None, 0, "x")] if r.random() < 0.8 else None))
    df = spark.createDataFrame(data, f"doc_id long, text string, edits {EDITS}")
    want = []
    for i, t, edits in data:
        text = t or ""
        todo = usable([dict(zip(("start", "stop", "new"), e, strict=True)) for e in edits or ()], len(text))
        after = text
        for a, z, new in reversed(todo):
            after = after[:a] + new + after[z:]
        want.append((i, len(encoding.encode_ordinary(text)), len(encoding.encode_ordinary(after)), len(todo)))
    got = token_counts(df, ranks, pattern).select("doc_id", "n_tokens", "n_tokens_edited", "n_edits").collect()
    assert by_repr(got) == by_repr(want)
    long = CountTree.of("word " * 40000, lambda x: len(x))
    long.edit(5, 9, "other")
    assert long.encoded < 3000 and long.total == 200001


def test_edits_across_a_leaf_start():
    encoding = load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda x: len(encoding.encode_ordinary(x))
    for lead in range(150, 215):
        for words in ("a@bcd.ef g@hij.kl and the rest of it", "a@bcd.ef g@hij.kl m@nop.qr s@tuv.wx y@zab.cd", "ab a@bcd.ef 12345678901 g@hij.kl"):
            text = "w " * lead + words + " tail" * 250
            edits = usable(cleaning_edits(text), len(text))
            tree, after = CountTree.of(text, count), text
            for a, z, new in reversed(edits):
                tree.edit(a, z, new)
                after = after[:a] + new + after[z:]
                assert tree.total == count(after), (lead, words)


def test_rounds_of_edits_on_small_leaves():
    import random

    encoding = load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda x: len(encoding.encode_ordinary(x))
    r = random.Random(7)
    bits_of_text = ["a", "bc", " ", "  ", " d", "1", "23", "'s", ".", "\n", " x y", "é"]
    text = "w " * 190 + "q" * 8 + " mail a@b.cd c@d.ef tail of the text and more words"
    tree = CountTree.of(text, count)
    for a, z, new in reversed(usable(cleaning_edits(text), len(text))):
        tree.edit(a, z, new)
    assert tree.total == 209
    for _ in range(3000):
        text = "".join(r.choice(bits_of_text) for _ in range(r.randint(0, 40)))
        parts, counts = CountTree.of(text, count, 5).kept(5)
        for _ in range(3):  # each round starts from what the one before has kept
            cuts = sorted(r.randint(0, len(text)) for _ in range(2 * r.randint(0, 4)))
            edits = [{"start": a, "stop": z, "new": r.choice(["", " ", "k", "[m]", " n o "])} for a, z in zip(cuts[::2], cuts[1::2], strict=True)]
            tree = CountTree(count, parts, counts)
            for a, z, new in reversed(usable(edits, len(text))):
                tree.edit(a, z, new)
                text = text[:a] + new + text[z:]
            parts, counts = tree.kept(5)
            assert "".join(parts) == text and tree.total == sum(counts) == count(text), (text, edits)


def test_kept_trees(spark, docs, rows):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = load_encoding(*vocabulary)
    trees = count_trees(docs, *vocabulary)
    assert by_repr(("".join(x["leaves"]), sum(x["counts"])) for x in trees.collect()) == by_repr((t or "", len(encoding.encode_ordinary(t or ""))) for _, t in rows)
    once = edit_trees(with_cleaning_edits(trees), *vocabulary)
    again = edit_trees(once.withColumn("edits", F.expr(f"cast(array(struct(0, 0, 'new ')) AS {EDITS})")), *vocabulary)
    after = [x["leaves"] for x in once.collect()]
    want = by_repr((len(encoding.encode_ordinary("".join(x))), len(encoding.encode_ordinary("new " + "".join(x)))) for x in after)
    assert by_repr(again.select("n_tokens", "n_tokens_edited").collect()) == want
    none = docs.where("1 = 0").withColumn("edits", F.expr(f"cast(NULL AS {EDITS})")).withColumn("leaves", F.lit(1))
    assert token_counts(none, *vocabulary).collect() == [] and count_trees(none, *vocabulary).collect() == []
    clash = docs.select("text", *(F.lit(1).alias(c) for c in ("row", "counts", "leaves", "n_tokens")), F.col("doc_id").alias("id"), F.expr(f"cast(NULL AS {EDITS})").alias("edits"))
    assert by_repr(token_counts(clash, *vocabulary, id_col="id").select("id", "n_edits").collect()) == by_repr((i, 0) for i, _ in rows)


def test_word_encoder(rows):
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in [t for _, t in rows] + ["a<|endoftext|>b <|ENDOFTEXT|>", "don't, 12345. ΣΑΣ é x\u3000y", '"Hi!"; (a.) b?! ...']:
        assert e.encode(text).tolist() == (e.tokenizer.encode(text, add_special_tokens=False).ids if text else [])
    texts = pa.array([t for _, t in rows], pa.string())
    for part in (texts, texts.slice(3, 7)):
        sizes, ids = e.encode_all(part)
        whole = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
        assert sizes.tolist() == list(map(len, whole)) and ids.tolist() == [i for x in whole for i in x]
    with pytest.raises(ValueError):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(spark, docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = WordEncoder(path).tokenizer.encode
    placed = pack(token_pieces(docs, path, 256), 256).toPandas()
    want = []
    for i, t in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in placed.itertuples()]
    assert by_repr(got) == by_repr(want)
    gapless(placed, 256)
    assert placed.sequence_id.nunique() <= best_fit_decreasing(placed.length, 256) * 1.02 + 1
    assert pack(token_pieces(docs.where("1 = 0"), path)).collect() == []


def gapless(placed, capacity):
    inner = placed.sort_values(["sequence_id", "offset"])
    by = inner.groupby("sequence_id").length
    assert (by.cumsum() - inner.length == inner.offset).all() and by.sum().max() <= capacity


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps: list[int] = []
    n = 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("kind", ["small", "equal", "thirds"])
def test_packing_of_lengths(spark, kind, monkeypatch):
    r = np.random.default_rng(6)
    lengths = {
        "small": r.integers(1, 40, 3000),
        "equal": np.full(700, 1000),
        "thirds": np.concatenate([r.integers(1300, 1400, 500), r.integers(1, 300, 500), r.integers(2600, 2900, 300)]),
    }[kind]
    monkeypatch.setattr("graphloom.llm.packing.MIN_RANGES", 3)
    monkeypatch.setattr("graphloom.llm.packing.ROWS_PER_RANGE", 200)
    df = spark.createDataFrame([(k, int(x), 1, "s") for k, x in enumerate(lengths)], "doc_id long, length long, seq int, row string")
    placed = pack(df).toPandas()
    assert sorted(zip(placed.doc_id, placed.length, strict=True)) == sorted(enumerate(lengths.tolist()))
    gapless(placed, 4096)
    assert placed.sequence_id.nunique() <= best_fit_decreasing(lengths.tolist(), 4096) * 1.02 + 1


def test_sweeps_between_ranges():
    assert between_ranges({0: (1, 3), 1: (2, 1), 2: (3, 0)}) == [(1, 0, 2, 0, 0), (2, 0, 1, 1, 0), (2, 1, 1, 0, 2)]
    assert between_ranges({}) == [] and between_ranges({3: (2, 0)}) == []


def all_cuts(word, pieces):
    if not word:
        yield []
    for end in range(1, len(word) + 1):
        piece = pieces.get(word[:end], 0) or (len(pieces) + 1 if end == 1 else 0)
        if piece:
            for rest in all_cuts(word[end:], pieces):
                yield [piece, *rest]


def test_sums_over_all_segmentations():
    import random

    r = random.Random(4)
    pieces = {x: k for k, x in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bbbb"], 1)}
    longest = max(map(len, pieces))
    p = np.random.default_rng(3).random((len(pieces) + 2, 3))
    p[0] = 0
    words = ["".join(r.choice("abc") for _ in range(9)) for _ in range(20)]
    cuts = [list(all_cuts("▁" + w, pieces)) for w in words]
    want = [sum(np.prod(p[c], axis=0) for c in x) for x in cuts]
    lattice = Lattice(words, pieces, longest)
    assert np.allclose(lattice.log_sums(p), np.log(want))
    assert np.allclose([long_word(w, pieces, longest, p) for w in words], np.log(want))
    weight = np.random.default_rng(5).random((len(words), 3))
    expected = np.zeros_like(p)
    for w, x, total in zip(weight, cuts, want, strict=True):
        for c in x:
            np.add.at(expected, c, w * np.prod(p[c], axis=0) / total)
    found = lattice.expected(p, weight)
    assert np.allclose(found[1:], expected[1:])
    for n in (40, 100, 3000):  # beyond the range of a float the parts of a word add up
        long = "".join(r.choice("abc") for _ in range(n))
        one, other = Lattice([long, long[::-1]], pieces, longest).log_sums(p * 1e-9), long_word(long, pieces, longest, p * 1e-9)
        assert np.isfinite(one).all() and np.allclose(one[0], other)
    steps = Lattice(["c" * 500], pieces, longest)
    assert np.allclose(steps.log_sums(p), np.log(p[pieces["▁"]]) + 500 * np.log(p[-1]))
    assert np.allclose(steps.expected(p, np.ones((1, 3)))[-1], 500)
    languages, learned = learn({"x": {"ab" * 60: 3}, "y": {"ba": 1}}, pieces)
    assert languages == ["x", "y"] and np.isfinite(learned).all() and (learned[1:] > 0).all()


def test_language_id_of_odd_tables(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    cols = "doc_id long, text string, lang string, score string, h int, word string"
    rows = [(1, "the house", "en"), (1, "the house", "en"), (None, "das Haus", "de"), (2, "", "en"), (3, None, None), (4, "haus " + "x" * 3000 + " haus", None)]
    df = spark.createDataFrame([(*x, "s", 1, "w") for x in rows], cols)
    found = language_id(df, F.lit(True), model)
    assert found.columns == ["doc_id", "lang_pred", "score"]
    got = by_repr(found.collect())
    assert [r[0] for r in got] == [1, 1, 2, 3, 4, None] and got[0] == got[1] and [r[1] for r in got[:4]] == ["en", "en", "und", "und"]
    assert got[5][1] == "de" and got[4][1] in ("de", "en")
    assert language_id(df.where("1 = 0"), F.lit(True), model).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op7_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.98


def suffix_tree_scores(texts, train, least, least_gain, max_depth):
    """(base, score, tokens under a node) of each text by plain dictionaries: the same rules, without chunks or hashes."""
    counts = [Counter(tuple(w[i - d : i + 1]) for w, t in zip(texts, train, strict=True) if t for i in range(d, len(w))) for d in range(max_depth + 1)]
    n = sum(counts[0].values())
    p = {x: (counts[0][(x,)] + 0.5) / (n + 0.5 * (len(counts[0]) + 1)) for w in texts for x in w}
    types = [Counter(e[:-1] for e in c) for c in counts]

    def share(context, x):
        if not context:
            return p[x]
        t, up = types[len(context)][context], share(context[1:], x)
        return (counts[len(context)][(*context, x)] + t * up) / max(counts[len(context) - 1][context] + t, 1e-9)

    gain: Counter = Counter()
    for d in range(1, max_depth + 1):
        for (*context, x), times in counts[d].items():
            c = tuple(context)
            gain[c] += times * (math.log((times - 1) / share(c[1:], x)) if times > 1 else math.log(types[d][c]))
    nodes = set()
    for c, g in gain.items():
        total = counts[len(c) - 1][c]
        if total >= least and g - total * math.log(total + types[len(c)][c]) >= least_gain * total:
            nodes.add(c)
    out = []
    for w in texts:
        score, deep = 0.0, 0
        for i, x in enumerate(w):
            known = [c for d in range(1, max_depth + 1) if i >= d for c in [tuple(w[i - d : i])] if c in nodes]
            score += math.log10(share(known[-1], x) if known else p[x])
            deep += bool(known)
        out.append((sum(math.log10(p[x]) for x in w), score, deep))
    return out


@pytest.mark.parametrize("least, max_depth, chunk_bytes", [(16, 3, 10_000), (4, 2, 1 << 20), (16, 0, 1 << 20)])
def test_lm_score(docs, rows, least, max_depth, chunk_bytes):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    is_held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*WORD.findall((t or "").translate(LOWER)), " end"] for _, t in rows]
    train = Counter(x for (i, _), w in zip(rows, tokens, strict=True) if not is_held(i) for x in w)
    model = suffix_tree_scores(tokens, [not is_held(i) for i, _ in rows], least, 0.01, max_depth)
    want = [
        (i, is_held(i), len(w), sum(train[x] > 0 for x in w), sum(train.values()), round(base, 5), round(score, 5), deep)
        for (i, _), w, (base, score, deep) in zip(rows, tokens, model, strict=True)
    ]
    scored = lm_score(docs, held, min_context=least, max_depth=max_depth, chunk_bytes=chunk_bytes).collect()
    got = [(*r[:5], round(r["base_score"], 5), round(r["score"], 5), r["n_context"]) for r in scored]
    assert by_repr(got) == by_repr(want)
    assert bool(max_depth) == (sum(r[7] for r in got) > 0)


def test_lm_score_of_nothing(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    assert lm_score(docs.where("1 = 0"), held).collect() == []
    untaught = lm_score(docs, F.lit(True)).toPandas()
    assert (untaught.train_tokens == 0).all() and (untaught.n_known == 0).all() and (untaught.score == untaught.base_score).all()


def test_keys_and_counts():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        for top in (1 << 20, 1 << 64):
            keys = np.unique(r.integers(0, top - 1, n, np.uint64, endpoint=True))
            keys = np.unique(keys >> np.uint64(8)) << np.uint64(8)
            assert (unpack_keys(pack_keys(keys)) == keys >> np.uint64(8)).all()
        counts = r.choice([0, 1, 254, 255, 256, 1 << 33], n).astype(np.int64)
        data = b"ab" + pack_counts(counts) + b"c"
        back, end = unpack_counts(data, 2)
        assert (back == counts).all() and data[end:] == b"c"


def test_word_hashes(rows, monkeypatch):
    texts = [(t or "").encode() for _, t in rows]
    sizes, h = word_hashes(texts)
    words = [w for t in texts for w in t.decode().translate(LOWER).encode().split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    monkeypatch.setattr("graphloom.llm.words.BLOCK_BYTES", 50)
    assert (word_hashes(texts)[1] == h).all() and (word_hashes(texts)[0] == sizes).all()


@pytest.mark.parametrize("n_filler", [2_000, 400_000])
def test_lm_contexts_at_any_size(spark, n_filler):
    import random

    r = random.Random(2)
    vocabulary = [f"f{k}" for k in range(50)]
    filler = [r.choices(vocabulary, k=n_filler // 40) for _ in range(40)]
    for word, times in (("often", 16), ("seldom", 15)):
        for k in range(times):
            filler[k] += [word, f"after-{word}", *r.choices(vocabulary, k=9)]
    data = [*((k, " ".join(w)) for k, w in enumerate(filler)), (100, "often after-often"), (101, "seldom after-seldom")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {x["doc_id"]: x["n_context"] for x in lm_score(df, F.col("doc_id") >= 100, chunk_bytes=100_000).where("held_out").collect()}
    assert got == {100: 1, 101: 0}


def test_lm_distinct_values():
    r = np.random.default_rng(3)
    close = np.array([5, 4, 5, 4, 1 << 63, (1 << 63) + 1, 1 << 63], np.uint64)  # told apart by low bits alone
    for values in (np.empty(0, np.uint64), close, r.integers(0, 50, 1000).astype(np.uint64), r.integers(0, 1 << 63, 1000).astype(np.uint64)):
        got, want = lm.distinct(values), np.unique(values, return_inverse=True)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_lm_packing():
    r = np.random.default_rng(4)
    for counts in (np.empty(0, np.int64), np.array([7]), r.choice([0, 1, 255, 1 << 33], 3000), r.geometric(0.8, 3000)):
        data = b"ab" + lm.pack(counts) + lm.pack_bytes(b"xyz") + b"c"
        back, at = lm.unpack(data, 2)
        assert (back == counts).all() and lm.unpack_bytes(data, at) == (b"xyz", len(data) - 1)
    assert len(lm.pack(r.geometric(0.8, 10_000))) < 3000


def test_lm_contexts_go_as_numbers():
    r = np.random.default_rng(5)
    words = r.zipf(1.3, 60_000) % 3000
    t = lm._Chunk(pa.table({"id": [1], "text": [" ".join(map(str, words))], "held": [False]}), None, 4)

    def counted(places, depth):
        n, full = t.own(places)[places.shared], bytes([255]) * ((int(places.shared.sum()) + 7) // 8)
        numbers = np.arange((n >= 4).sum())
        t.answers[lm.counts_level(depth)] = {0: lm.pack(n) + lm.pack_bytes(full) + lm.pack_bytes(bytes(len(full))) + lm.pack(np.diff(numbers, prepend=0))}
        return t.counted(places, depth)

    up = counted(t.words(), 0)
    places = counted(t.longer(up), 1)
    sent = t.ask_contexts(0, 1, places, up, (up.n + 0.5) / len(words), 1)
    n_contexts = len(t.contexts(places, up)[0])
    assert n_contexts > 500
    assert sum(len(x.as_py()) for c in ("keys", "data") for x in sent.column(c)) < 9 * n_contexts


@pytest.mark.parametrize("chunk_bytes", [500, 1 << 20])
def test_lm_contexts_of_one_chunk(spark, chunk_bytes):
    import random

    r = random.Random(6)
    many = [" ".join(r.choices("abcdefg", k=60)) for _ in range(40)]
    texts = [*many, "p q r " * 30 + "p q s", "t u v " * 20, *["w x"] * 20, *many[:3]]
    held = [k % 5 == 1 for k in range(len(texts))]
    want = suffix_tree_scores([[*t.split(), " end"] for t in texts], [not h for h in held], 8, 0.01, 3)
    df = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held boolean")
    got = lm_score(df, F.col("held"), min_context=8, chunk_bytes=chunk_bytes).orderBy("doc_id").collect()
    assert [(round(x["base_score"], 5), round(x["score"], 5), x["n_context"]) for x in got] == [(round(b, 5), round(c, 5), n) for b, c, n in want]
