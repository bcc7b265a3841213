"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A word's probability in a language is the sum over all ways to cut it into pieces of the vocabulary of the product of
the pieces' probabilities, by a forward pass. Pieces never cross words, so a text's sum is the product over its words.
The probabilities are learned by expectation-maximisation: expected piece counts come from a forward-backward pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many labelled documents of each language are taken to learn from, by a hash of their id.
SAMPLE_PER_LANGUAGE = 200
ROUNDS = 2
SMOOTHING = 0.01
#: log probability of a character that the vocabulary lacks, in any language.
UNKNOWN = -14.0
#: Words whose probabilities a task keeps at most; the store starts anew when it is full.
STORE_WORDS = 300_000
#: Documents whose new words are scored together.
DOCS_AT_ONCE = 512
#: Words of more letters are summed one by one, to the same result with less room.
ONE_AT_A_TIME = 256
UNDECIDED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none for null."""
    return _LETTERS.findall(text.lower()) if text else []


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model that stand for text, numbered from 1."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: k for k, p in enumerate(dict.fromkeys(pieces), 1)}


class Lattice:
    """All cuts of words of one length into pieces, as piece numbers; 0: no such piece, one more than the last: unknown.

    Places are taken in stretches as long as the longest piece. Sums are kept next to a scale for each stretch, word and
    language, so that they don't leave the range of a float however long the words are.
    """

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int):
        marked = [_START + w for w in words]
        self.n, self.stretch = len(marked[0]), max(16, longest)
        self.edges: list[tuple[int, int, np.ndarray]] = []
        get, unknown = pieces.get, len(pieces) + 1
        for end in range(1, self.n + 1):
            for start in range(max(0, end - longest), end):
                ids = [get(w[start:end], 0) for w in marked]
                if end - start == 1:
                    ids = [i or unknown for i in ids]
                ids = np.array(ids, np.int32)
                if ids.any():
                    self.edges.append((start, end, ids))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Scaled sums up to each place by word and column of p, the log of the last scale, and the scales' steps."""
        a = np.zeros((self.n + 1, len(self.edges[0][2]), p.shape[1]))
        a[0] = 1
        steps, log_scale = [np.ones(a.shape[1:])], np.zeros(a.shape[1:])
        for start, end, ids in self.edges:
            if end // self.stretch == len(steps):  # the stretch before is whole
                largest = a[end - self.stretch : end].max(axis=0)
                steps.append(1 / np.maximum(largest, 1e-300))
                log_scale += np.log(np.maximum(largest, 1e-300))
            share = a[start] * p[ids]
            a[end] += share if start // self.stretch == end // self.stretch else share * steps[-1]
        return a, log_scale, steps

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of the words' sums over all cuts."""
        a, log_scale, _ = self.forward(p)
        return np.log(a[self.n]) + log_scale

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of the words, with a weight by word and column."""
        a, _, steps = self.forward(p)
        b = np.zeros_like(a)
        b[self.n] = weight / a[self.n]
        out = np.zeros_like(p)
        for start, end, ids in reversed(self.edges):
            share = p[ids] * b[end]
            if start // self.stretch != end // self.stretch:
                share *= steps[end // self.stretch]
            b[start] += share
            share *= a[start]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(ids, share[:, k], len(p))
        return out


def long_word(word: str, pieces: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """`Lattice.log_sums` of one word of any length, with room for the last `longest` sums only."""
    marked, unknown, total = _START + word, len(pieces) + 1, np.zeros(p.shape[1])
    sums = np.zeros((longest, p.shape[1]))  # sums up to the latest places, the last one first
    sums[0] = 1
    get = pieces.get
    for end in range(1, len(marked) + 1):
        new = sums[0] * p[get(marked[end - 1], unknown)]
        for back in range(2, min(longest, end) + 1):
            if piece := get(marked[end - back : end]):
                new += sums[back - 1] * p[piece]
        sums[1:] = sums[:-1].copy()
        sums[0] = new
        if not end % 16:
            largest = sums.max(axis=0)
            sums /= largest
            total += np.log(largest)
    return np.log(sums[0]) + total


def _by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Words in groups of one length, with their places."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for at in groups.values():
        for k in range(0, len(at), 5000):
            yield at[k : k + 5000], [words[i] for i in at[k : k + 5000]]


def learn(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a row of piece probabilities for each piece number, by language."""
    languages = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[lang].get(w, 0) for lang in languages] for w in words], float)
    longest = max(map(len, pieces))
    size = np.array([0, *map(len, pieces), 1])
    p = np.repeat((10.0 ** -np.minimum(size, 4))[:, None], len(languages), 1)
    p[0], p[-1] = 0, np.exp(UNKNOWN)
    lattices = [(at, Lattice(some, pieces, longest)) for at, some in _by_length(words)]
    for _ in range(rounds):
        found = sum((x.expected(p, weight[at]) for at, x in lattices), np.zeros_like(p)) + SMOOTHING
        found[0] = found[-1] = 0
        p = found / found.sum(axis=0)
        p[-1] = np.exp(UNKNOWN)
    return languages, p


def language_id(
    docs: DataFrame,
    learn_from: Column,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """Per input row: id_col, lang_pred and score, the share of the predicted language among all learned ones.

    Learns from rows where `learn_from`, a condition over `docs`, holds and text and language are not null; about
    `per_language` of each language, chosen by a hash of id and text, so learning stays bounded. Prediction takes the
    whole text and nothing else. A text that is null or has no letter gives `und` and 0, and so does any text if there
    is nothing to learn from. Equal scores go to the language first in order. Repeated rows each give a row.
    """
    pieces = vocabulary(model_path)
    known = docs.where(learn_from).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    sample = known.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        for b in batches:
            rows = [(lang, w) for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) for w in words_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["lang", "word"])

    counts: dict[str, dict[str, int]] = {}
    for r in sample.select("lang", "text").mapInArrow(count, "lang string, word string").groupBy("lang", "word").count().toLocalIterator():
        counts.setdefault(r["lang"], {})[r["word"]] = r["count"]
    languages, p = learn(counts, pieces) if counts else ([], np.zeros((len(pieces) + 2, 0)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = max(map(len, pieces))
        slots: dict[str, int] = {}
        logs = np.zeros((1 << 14, len(languages)))
        for b in batches:
            for first in range(0, b.num_rows, DOCS_AT_ONCE):
                part = b.slice(first, DOCS_AT_ONCE)
                texts = [words_of(t.as_py()) for t in part.column("text")]
                new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in slots]
                if len(slots) + len(new) > STORE_WORDS:
                    slots.clear()
                    new = list(dict.fromkeys(w for words in texts for w in words))
                while len(slots) + len(new) > len(logs):
                    logs = np.concatenate([logs, np.zeros_like(logs)])
                for _, some in _by_length(new) if languages else ():
                    known = len(slots)
                    slots.update(zip(some, range(known, known + len(some)), strict=True))
                    if len(some[0]) > ONE_AT_A_TIME:
                        logs[known : known + len(some)] = [long_word(w, pieces, longest, p) for w in some]
                    else:
                        logs[known : known + len(some)] = Lattice(some, pieces, longest).log_sums(p)
                found, score = [], []
                for words in texts:
                    if languages and any(c.isalpha() for w in words for c in w):
                        total = logs[list(map(slots.__getitem__, words))].sum(axis=0)
                        found.append(languages[int(np.argmax(total))])
                        score.append(float(1 / np.exp(total - total.max()).sum()))
                    else:
                        found.append(UNDECIDED)
                        score.append(0.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    start = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return start.mapInArrow(predict, f"id {start.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    found = language_id(docs, ~held, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
