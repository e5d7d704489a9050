import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts(seed: int, n: int = 60) -> list:
    """Texts with copies, near copies, shared passages, repeated lines, nulls, blanks and one very long one."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]
    some = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = some(70), some(12)
    out = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not out:
            out.append("\n".join(some(r.randint(5, 60)) for _ in range(r.randint(1, 4))))
        elif kind == 1:
            out.append(r.choice(out) if r.random() < 0.5 else f"{some(20)} {passage}\n{line}\n{some(15)}")
        elif kind == 2:
            w = (r.choice(out) or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(f"{some(30)}\n{line}\n{some(10)} {passage} {some(3)}")
        elif kind == 4:
            out.append(r.choice([None, "", "  \n\t ", "one", "one two three", "Ünï cödé wörds", some(49), some(50)]))
        else:
            out.append(f"{line} {r.choice(vocabulary)}\n{some(40)}")
    out.append("\n".join(some(50) for _ in range(120)))
    return out


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **columns):
        rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def texts():
    return make_texts
