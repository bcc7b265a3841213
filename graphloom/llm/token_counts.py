"""Edit-aware token counts: a segment tree of token counts for each document.

A text is cut into leaves of a few hundred characters where its pre-tokens are sure to part, before a single space
between two other characters. An edit touches the leaves around it; only these are encoded again, and the sums on the
way up are updated. Trees are rows of a table (id, leaves, counts), so they are kept from one round of edits to the next.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

LEAF_CHARS = 400
#: Rows whose trees a task holds as Python objects.
ROWS_AT_ONCE = 256

_CUT = re.compile(r"(?<=\S) (?=\S)")

# What the production edits mask.
MASKS = (
    (re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+"), "[email]"),
    (re.compile(r"\+?\d[\d ().-]{7,}\d"), "[number]"),
)


def load_encoding(path: str, pattern: str):
    """A byte-level encoding from a file of ranks; special tokens count as ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The leaves of a text, one at least; its pre-tokens are those of its leaves."""
    starts = [0]
    while m := _CUT.search(text, starts[-1] + size):
        starts.append(m.start())
    return [text[a:z] for a, z in zip(starts, [*starts[1:], len(text)], strict=True)]


class CountTree:
    """Token counts of a text's leaves and their sums, under edits from the right to the left."""

    def __init__(self, count: Callable[[str], int], parts: list[str], counts: list[int]):
        self.count, self.parts = count, list(parts)
        self.starts = [0, *accumulate(map(len, parts))]
        self.length = self.starts.pop()
        self.leaf = list(range(len(parts)))
        self.size = 1 << (len(parts) - 1).bit_length()
        self.sums = [0] * self.size + list(counts) + [0] * (self.size - len(parts))
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
        self.encoded = 0

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], size: int = LEAF_CHARS) -> CountTree:
        parts = cut_leaves(text, size)
        return cls(count, parts, [count(p) for p in parts])

    def kept(self, size: int = LEAF_CHARS) -> tuple[list[str], list[int]]:
        """Leaves and their counts as edits have left them; leaves that have grown long are cut, and counted, anew."""
        parts, counts = [], []
        for leaf, part in zip(self.leaf, self.parts, strict=True):
            if len(part) <= 4 * size:
                parts.append(part)
                counts.append(self.sums[self.size + leaf])
            else:
                more = cut_leaves(part, size)
                parts += more
                counts += map(self.count, more)
                self.encoded += len(part)
        return parts, counts

    @property
    def total(self) -> int:
        return self.sums[1]

    def _set(self, leaf: int, n: int) -> None:
        k = leaf + self.size
        change = n - self.sums[k]
        while change and k:
            self.sums[k] += change
            k >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in place of characters start to end of the original text; nothing right of it may change later."""
        first = bisect_right(self.starts, max(0, start - 2)) - 1
        last = bisect_right(self.starts, min(end, max(0, self.length - 1))) - 1
        at = bisect_right(self.starts, start) - 1
        to = bisect_right(self.starts, end) - 1
        kept = "".join(self.parts[first:at]) + self.parts[at][: start - self.starts[at]]
        # edits come from the right, so a leaf that an earlier one has changed or merged is as it was up to `end`
        tail = self.parts[to][end - self.starts[to] :] + "".join(self.parts[to + 1 : last + 1])
        self.parts[first] = kept + new + tail
        merged = slice(first + 1, last + 1)
        for k in self.leaf[merged]:
            self._set(k, 0)
        # the text of merged leaves is found under the start of the one that holds it
        del self.starts[merged], self.parts[merged], self.leaf[merged]
        n = self.count(self.parts[first])
        self.encoded += len(self.parts[first])
        self._set(self.leaf[first], n)


def usable(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits in order, without those that have a null, reach outside the text or overlap one that starts earlier."""
    out, at = [], 0
    for e in sorted((e["start"], e["stop"], e["new"]) for e in edits or () if e and None not in e.values()):
        if at <= e[0] <= e[1] <= length:
            out.append(e)
            at = max(e[1], e[0] + 1) if e[0] == e[1] else e[1]
    return out


EDITS = "array<struct<start:int,stop:int,new:string>>"
_TREE = "leaves array<string>, counts array<int>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, not many at once."""
    for b in batches:
        for a in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(a, ROWS_AT_ONCE)


def _counter(ranks_path: str, pattern: str) -> Callable[[str], int]:
    encoding = load_encoding(ranks_path, pattern)
    return lambda text: len(encoding.encode_ordinary(text))


def count_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id_col, leaves (which joined are the text) and counts, the tokens of each leaf.

    A null text counts as empty, which is one empty leaf. Repeated rows each give a row; other columns are not looked at.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(ranks_path, pattern)
        for b in _parts(batches):
            leaves = [cut_leaves(t.as_py() or "") for t in b.column("text")]
            counts = pa.array([list(map(count, x)) for x in leaves], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(leaves, pa.list_(pa.string())), counts], ["id", "leaves", "counts"])

    start = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return start.mapInArrow(counted, f"id {start.schema['id'].dataType.simpleString()}, {_TREE}").withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", edits_col: str = "edits", keep: bool = True) -> DataFrame:
    """Trees after their edits: id_col, leaves and counts, to be kept for the next round, and n_tokens (before the
    edits), n_tokens_edited, n_edits and n_chars_encoded_again; without leaves and counts if they are not to be kept.

    `edits_col` holds (start, stop, new): characters start to stop of the text, from 0, become `new`. Edits that have a
    null, reach outside the text or overlap one that starts earlier are left out, as is the whole list if null.
    """

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(ranks_path, pattern)
        for b in _parts(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for leaves, counts, edits in zip(b.column("leaves"), b.column("counts"), b.column("edits"), strict=True):
                tree = CountTree(count, leaves.as_py(), counts.as_py())
                before, todo = tree.total, usable(edits.as_py(), tree.length)
                for e in reversed(todo):
                    tree.edit(*e)
                for col, x in zip(cols, (*(tree.kept() if keep else (None, None)), before, tree.total, len(todo), tree.encoded), strict=True):
                    col.append(x)
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.int64()] * 4)
            names = ["leaves", "counts", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_encoded_again"]
            found = [(n, pa.array(c, k)) for n, c, k in zip(names, cols, kinds, strict=True)][0 if keep else 2 :]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(c for _, c in found)], ["id", *(n for n, _ in found)])

    start = trees.select(F.col(id_col).alias("id"), "leaves", "counts", F.col(edits_col).alias("edits"))
    schema = f"id {start.schema['id'].dataType.simpleString()}, {_TREE + ', ' if keep else ''}n_tokens bigint, n_tokens_edited bigint, n_edits bigint, n_chars_encoded_again bigint"
    return start.mapInArrow(edited, schema).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Per input row: id_col, n_tokens, n_tokens_edited, n_edits, n_chars_encoded_again, for one round of edits.

    Trees are counted and edited as by `count_trees` and `edit_trees`, and not kept.
    """
    carried = docs.select(F.struct(F.col(id_col).alias("id"), F.col(edits_col).alias("edits")).alias("row"), F.col(text_col).alias("text"))
    trees = count_trees(carried, ranks_path, pattern, "row").select("row.*", "leaves", "counts")
    return edit_trees(trees, ranks_path, pattern, "id", "edits", keep=False).withColumnRenamed("id", id_col)


def cleaning_edits(text: str | None) -> list[dict]:
    """The production edits: mails and long numbers are masked, a line that equals an earlier one goes."""
    found, seen, at = [], set(), 0
    for line in (text or "").split("\n"):
        if line in seen and line.strip():
            found.append({"start": at, "stop": min(at + len(line) + 1, len(text)), "new": ""})
        else:
            seen.add(line)
            for mask, new in MASKS:
                found += [{"start": at + m.start(), "stop": at + m.end(), "new": new} for m in mask.finditer(line)]
        at += len(line) + 1
    return found


def with_cleaning_edits(trees: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Trees, and as `edits` those of `cleaning_edits` for their texts."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            edits = [cleaning_edits("".join(x.as_py())) for x in b.column("leaves")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edits, kind)], ["id", "leaves", "counts", "edits"])

    start = trees.select(F.col(id_col).alias("id"), "leaves", "counts")
    schema = f"id {start.schema['id'].dataType.simpleString()}, {_TREE}, edits {EDITS}"
    return start.mapInArrow(find, schema).withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = written(count_trees(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary), "count-trees")
    return edit_trees(with_cleaning_edits(trees), *vocabulary, keep=False)
