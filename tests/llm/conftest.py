import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, packed int, bands string, row int, _row int, h1 string, hash int, comp int"


def words(n, seed):
    r = random.Random(seed)
    syllables = ["the", "ing", "an", "er", "lo", "ka", "mi", "tor", "wen", "dri"]
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]


def texts():
    """(doc_id, text): plain, null, empty, blank, letterless, very long, exact and near copies, repeated rows, null ids."""
    base = words(120, 1)
    near = base[:]
    near[60] = "changed"
    passage = " ".join(words(60, 2))
    out = [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, "  \n\t "),
        (7, "12345 --- 67"),
        (8, "ab"),
        (9, " ".join(words(30000, 3))),
        (10, " ".join(words(40, 4)) + " " + passage + " " + " ".join(words(40, 5))),
        (11, " ".join(words(30, 6)) + "\n" + passage + " " + " ".join(words(50, 7))),
        (12, "A été. Überall ñandú 漢字 \U0001f600 mail a.b@c.de +1 (555) 555-2485 or 555-2485, 4111111111111111 and 10.0.0.1 10.0.0.300"),
        (12, "A été. Überall ñandú 漢字 \U0001f600 mail a.b@c.de +1 (555) 555-2485 or 555-2485, 4111111111111111 and 10.0.0.1 10.0.0.300"),
        (13, "same id, one text " + " ".join(words(30, 8))),
        (13, "same id, other text " + " ".join(words(30, 9))),
        (None, " ".join(base)),
        (None, " ".join(words(80, 10))),
        (14, " ".join(["again"] * 200)),
        (15, "x" * 200_000),
    ]
    out += [(100 + i, " ".join(words(60, 100 + i))) for i in range(40)]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With nulls in every column and columns named as the operators' own."""
    full = [(i, t, ["en", "de", None][k % 3], None if k % 4 else "s", None, "c", None, "b", k, None, "h", 1, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
