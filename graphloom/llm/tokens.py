"""Token ids of whole texts by a public tokenizer, through a store of the ids of words already seen."""

from __future__ import annotations

import ctypes
import os
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids are kept at most, by each worker as long as it lives; the store starts anew when it is full.
STORE_WORDS = 300_000

_TAIL = ".,!?;:|#$%&*"
#: Words of letters that are encoded in one line.
LINE_WORDS = 1000


def give_back() -> None:
    """Memory that a task has freed goes back to the machine, as its worker lives on and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` places each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text is about that long; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    run = np.cumsum(size) // most_bytes
    first = np.flatnonzero(np.diff(run, prepend=-1))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, z - a)


class WordEncoder:
    """Encodes texts word by word with a lower-casing tokenizer whose pieces never cross ASCII white space.

    A word that ends in marks after a letter or digit is its body and its marks, which are encoded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("A b", "a\n b")] != [[*self._ids("a"), *self._ids("b")]] * 2:
            raise ValueError(f"{path} does not lower words and encode them apart")
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a run of letters.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.store: dict[str, int] = {"": 0}
        # of each stored word: where its ids start in the flat array, and how many they are
        self.ids, self.start, self.size = array("I"), array("q", [0]), array("q", [0])

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.store.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        sizes = sizes.astype(np.int64)
        self.start.frombytes((len(self.ids) + np.cumsum(sizes) - sizes).tobytes())
        self.size.frombytes(sizes.tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())

    def _learn(self, words: list[str]) -> None:
        """Ids of new words; those of letters alone are encoded many in a line and told apart by their last pieces."""
        letters = [w for w in words if w.isalpha() and w == w.lower() and is_normalized("NFC", w)]
        alone = set(words).difference(letters)
        lines = [letters[i : i + LINE_WORDS] for i in range(0, len(letters), LINE_WORDS)]
        for line, e in zip(lines, self._encoded([" ".join(x) for x in lines]), strict=True):
            ids = np.array(e.ids, np.int64)
            sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(sizes) == len(line) and sizes.sum() == len(ids):
                self._keep(line, sizes, ids)
            else:
                alone.update(line)
        rest = sorted(alone)
        found = [np.array(e.ids, np.int64) for e in self._encoded(rest)]
        self._keep(rest, np.array([len(x) for x in found]), np.concatenate([np.empty(0, np.int64), *found]))

    def _encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _slots(self, words: list[str]) -> np.ndarray:
        found = list(map(self.store.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w in words if w not in self.store))
            if len(self.store) + len(new) > STORE_WORDS:
                self._clear()
                new = list(dict.fromkeys(w for w in words if w))
            self._learn(new)
            found = list(map(self.store.get, words))
        return np.array(found, np.int64)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the uint32 ids of all texts; a null has none."""
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|")  # special tokens are told apart by case
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        different = words.dictionary
        body = pc.ascii_rtrim(different, characters=_TAIL)
        parts = pc.and_(pc.not_equal(body, different), pc.match_substring_regex(body, "[a-z0-9]$"))
        body = pc.if_else(parts, body, different).to_pylist()
        tail = [w[len(b) :] for w, b in zip(different.to_pylist(), body, strict=True)]
        pair = self._slots([*body, *tail]).reshape(2, -1).T.ravel()  # of each word its body and its marks
        size = np.frombuffer(self.size, np.int64)[pair]
        flat = np.frombuffer(self.ids, np.uint32)[_runs(np.frombuffer(self.start, np.int64)[pair], size)]
        size = size.reshape(-1, 2).sum(axis=1)
        start, which = np.cumsum(size) - size, words.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[which])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.diff(upto), flat[_runs(start[which], size[which])]

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of the whole text; none for null."""
        return self.encode_all(pa.array([text], pa.string()))[1]


def word_encoder(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer, with the words that earlier tasks have left in its store."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_word_encoders", {})  # a module that outlives a task; shipped code doesn't
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
