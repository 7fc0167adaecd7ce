import random

import pytest

EXTRA = "doc_id long, text string, unit int, label long, tokens string, part int, place string, n long, `a b` double"


@pytest.fixture
def docs(make):
    """Rows (doc_id, text) as a table that also has columns under names the operators use inside."""
    def build(rows):
        return make([(i, t, 7, 7, "x", 7, "x", 7, 0.5) for i, t in rows], EXTRA)
    return build


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, one id with two texts, null ids, long texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(3, 90))) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, prose[0]), (6, prose[0]), (6, prose[1]),
            (None, prose[0]), (None, prose[0]), (None, "only here " + prose[2]), (7, "x" * 30_000), (8, prose[3] + " é 日本  end"),
            (9, " ".join(prose) * 20)]
    rows += [(10 + i, p) for i, p in enumerate(prose)]
    rows += [(100 + i, p.replace("a", "A", 1)) for i, p in enumerate(prose)]
    rows += [(200 + i, p + " " + word()) for i, p in enumerate(prose)]
    return rows
