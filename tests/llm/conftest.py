import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


def some_texts(seed=0, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, odd characters; null, empty and long ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßαñ") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["The", "OF", "a,", "b.", "42", "##", "$$$"]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, menu = make(70), " ".join(make(9)) + "\n" + " ".join(make(8)) + "\n" + " ".join(make(7))
    out = [None, "", " \t\n ", "one two", "one two", "One TWO", "a", "\x0b\x0c x y   z"]
    for k in range(n):
        w = make(r.choice([3, 8, 40, 120, 300]))
        if k % 5 == 1:
            at = r.randint(0, len(w))
            w[at:at] = passage
        text = "".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)
        if k % 7 == 2:
            text = text + "\n" + menu + "\nend " + str(k)
        if k % 6 == 3:
            text += " ".join(["again and again my friend"] * 9)
        out.append(text)
        if k % 4 == 0:
            out.append(text)
        if k % 4 == 1:
            w2 = text.split(" ")
            w2[len(w2) // 2] = "changed"
            out.append(" ".join(w2))
    out.append(" ".join(make(20000)))
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def texts():
    return some_texts()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, k int, hash long, rep long"


def frame(spark, texts):
    """A table of documents with extra columns whose names clash with those that the operators use."""
    rows = [(i, t, None, "s", None if t is None else len(t), 0.5, None, 7, i, None) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def scratch(spark):
    from isoweave.llm.common import Scratch

    return Scratch(spark, "test")
