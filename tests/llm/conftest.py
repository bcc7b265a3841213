import random

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names the operators use themselves.
EXTRA = "chunk long, row string, kept string, n_words long, id long, length string, words string, bucket int, label string, label2 int"


def sample_texts() -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, repeats, odd spaces and letters, and one very long one."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["the", "of", "Über", "née", "日本", "don't", "x.", "#tag", "ÀÉ"]
    passage = [r.choice(words) for _ in range(60)]
    texts: list[str] = []
    for k in range(60):
        w = [r.choice(words) for _ in range(r.randint(1, 160))]
        if k % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[: r.choice((20, 40, 60))]
        text = "".join(x + r.choice((" ", " ", "\n", "  ", "\t")) for x in w)
        texts.append(text)
        if k % 5 == 0:
            texts += [text] * r.randint(1, 3)
        if k % 3 == 0:
            w[r.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += ["a b c " * 30, "A B c", "a b", "A", "", " \n\t", "\u00a0", "\u0085 x", " ".join(r.choice(words) for _ in range(6000))]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, (500, None), (None, texts[0]), (None, None), (3, texts[3]), (3, "another text under an id that is there")]


@pytest.fixture(scope="session")
def rows():
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    junk = (1, "r", "k", 2, 3, "l", "w", 4, "b", 5)
    return spark.createDataFrame([(*x, *junk) for x in rows], f"doc_id long, text string, {EXTRA}").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")
