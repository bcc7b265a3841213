"""Operators on conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm.chat_format import END, SAYS, TURN, chat_examples, digests, escaped, read_back, unescaped
from graphloom.llm.prefix_trie import prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, example string, piece long, n int, whole string, path string, block int"


def sample_turns() -> list[tuple]:
    """Conversations that share beginnings, with null and empty values, ties, repeats, control strings and a long one."""
    r = random.Random(11)
    says = ["", "a", "b\n", "é日本", "<turn>", "</turn>", "<\\turn>", "<\\\\/turn>", "<says>", "\\", "<", "</tur", "n>", "a<", r"\1 $1", "x" * 300]
    rows = []
    for c in range(160):
        shared = random.Random(c % 4)
        for t in range(r.randint(1, 7)):
            role, text = (shared.choice(("user", "assistant")), shared.choice(says)) if r.random() < 0.8 else (r.choice(("user", "assistant", "system", None)), r.choice([*says, None]))
            rows.append((c + 37, t, role, text))
    rows += [(-3, None, "user", "no number"), (-3, 0, "assistant", "b"), (-3, 0, "assistant", "a"), (-3, 0, "assistant", "a")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (9000, 0, "assistant", None), (9001, 5, None, None), (9002, 0, "<says>", "</turn><turn>")]
    rows += [(9100, t, ("user", "assistant")[t % 2], f"{t} " * (t % 50)) for t in range(700)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def turns():
    return sample_turns()


@pytest.fixture(scope="module")
def table(spark, turns):
    return spark.createDataFrame([(*t, "e", 1, 2, "w", "p", 3) for t in turns], SCHEMA).cache()


def conversations(turns, tie):
    found = defaultdict(list)
    for c, t, role, text in turns:
        found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for *_, role, text in sorted(rows, key=lambda x: (x[0], x[1], tie(*x[2:])))] for c, rows in found.items()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def one_escaped(text: str) -> str:
    """By hand: one backslash more behind the < of what would read as a control string without its backslashes."""
    out, at = "", 0
    while at < len(text):
        if text[at] == "<":
            rest = text[at + 1 :]
            bare = rest.lstrip("\\")
            if bare.startswith(("turn>", "says>", "/turn>")):
                out += "<\\"
                at += 1
                continue
        out, at = out + text[at], at + 1
    return out


def piece(role: str, text: str) -> str:
    return TURN + one_escaped(role) + SAYS + one_escaped(text) + END


def test_escape(spark):
    texts = ["", "<turn>", "<\\turn>", "<\\\\turn>", "<says></turn>", "<<turn>", "\\</turn>", "<\\x>", "a <b> \\n", "<tu<turn>rn>", "<\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped("t").alias("e"), unescaped(escaped("t")).alias("u")).collect()
    assert [r.u for r in rows] == texts
    assert [r.e for r in rows] == [one_escaped(t) for t in texts]
    assert not any(c in r.e for r in rows for c in (TURN, SAYS, END))


def test_examples(table, turns):
    got = defaultdict(list)
    for r in chat_examples(table).collect():
        got[r.conv_id].append(r)
    want = conversations(turns, piece)
    assert got.keys() == want.keys()
    for c, said in want.items():
        rows = sorted(got[c], key=lambda r: r.example)
        assert [r.example for r in rows] == list(range(len(rows)))
        targets = [k for k, (role, _) in enumerate(said) if role == "assistant"]
        ends = targets if targets and targets[-1] == len(said) - 1 else [*targets, len(said) - 1]
        assert [r.text for r in rows] == ["".join(piece(*t) for t in said[: k + 1]) for k in ends]
        assert [r.is_whole for r in rows] == [k == len(said) - 1 for k in ends]
        masks = [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in rows]
        assert masks == [one_escaped(said[k][1]) if k in targets else "" for k in ends]


def test_chat_digests(table, turns):
    got = {r.conv_id: tuple(r)[1:] for r in digests(read_back(chat_examples(table))).collect()}
    want = {}
    for c, said in conversations(turns, piece).items():
        lengths = [sum(len(piece(*t)) for t in said[: k + 1]) for k, (role, _) in enumerate(said) if role == "assistant" or k == len(said) - 1]
        loss = "".join(text for role, text in said if role == "assistant")
        want[c] = (len(said), sha("".join(f"{role}\n{text}\n" for role, text in said)), len(loss), sha(loss), sum(lengths))
    assert got == want


def test_no_conversations(table):
    none = table.where("1 = 0")
    assert chat_examples(none).collect() == [] and digests(read_back(chat_examples(none))).collect() == []


def trie_by_hand(lists: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """The nodes of a trie of dictionaries."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in sorted(lists.items()):
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return {
        (members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(children[x]), leaves[x], saved[x], sha(",".join(map(str, ends[x]))))
        for x in members
    }


def by_digest(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt_by_hand(turns):
    own = conversations([t for t in turns if t[0] is not None], by_digest)
    lists = {}
    for c, said in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c - c // 100 * 100 if c >= 0 else -(-c - -c // 100 * 100))
        lists[c] = own.get(base, [])[:h] + said[h:]
    return lists


def test_trie_of_conversations(spark, table, turns):
    want = trie_by_hand(rebuilt_by_hand(turns))
    got = [tuple(r) for r in prefix_trie(rebuilt(table)).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("block_turns", [3, 60])
def test_trie_over_blocks(spark, block_turns):
    """Blocks smaller than groups of copies, in several rounds of merging."""
    r = random.Random(block_turns)
    lists = {}
    for k in range(330):
        said = [("r", r.choice("abc") * r.randint(1, 2)) for _ in range(r.choice((0, 1, 2, 2, 3, 5)))]
        lists[k * 7 - 300] = [("r", "copy"), ("r", "again")] if k % 3 == 0 else said
    lists[5] = [("r", "deep")] * 200
    lists[6] = [("r", "deep")] * 150 + [("r", "end")]
    table = spark.createDataFrame([(c, [by_digest(*t) for t in said], [len(t[1]) for t in said]) for c, said in lists.items()], "conv_id long, digests array<string>, chars array<int>")
    sequences = table.select("conv_id", F.unhex(F.array_join("digests", "")).alias("path"), "chars", F.lit("x").alias("key"))
    got = [tuple(r) for r in prefix_trie(sequences, block_turns).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(lists)


def test_trie_of_nothing(spark, table):
    assert prefix_trie(rebuilt(table.where("1 = 0"))).collect() == []
    assert prefix_trie(rebuilt(table.where("conv_id IS NULL"))).collect() == []
    one = spark.createDataFrame([(101, None, None, None)], "conv_id long, turn long, role string, text string")
    h = zlib.crc32(b"101") % 6
    assert sorted(tuple(r)[:7] for r in prefix_trie(rebuilt(one)).collect()) == ([(101, 0, None, 1, 0, 1, 0)] if h else [(101, 0, None, 1, 1, 1, 0), (101, 1, 101, 1, 0, 1, 0)])
