import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, phase int, score double"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = []
    base = prose(rng, 160)
    for i in range(60):
        kind = i % 6
        if kind == 0:
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            text = " ".join(words)
        elif kind == 1:
            text = base
        elif kind == 2:
            text = "\n".join(prose(rng, rng.randint(1, 30)) for _ in range(6)) + f"\nmail me at a{i}@b.example.com, 10.0.{i}.1 or +1 (974) 555-34{i:02d} and 4845168114407329"
        elif kind == 3:
            text = prose(rng, 80) + "\nSPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause\nReleased under the MIT License. GNU General Public License"
        elif kind == 4:
            text = "\n".join([prose(rng, 12)] * 5)
        else:
            text = prose(rng, rng.choice([1, 3, 50, 99]))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "  \n\t "), (None, prose(rng, 70)), (None, None), (103, rows[1][1]), (1, rows[1][1]), (1, rows[1][1]), (104, "ÀÉ ßü 😀 😀 " * 30), (105, "x" * 30_000 + " " + "1" * 6000), (106, prose(rng, 20_000))]
    return [(i, t, "en", None if (i or 0) % 9 == 8 else f"src{(i or 0) % 4 if (i or 0) % 3 else 0}", None, 1, 2, 3, 4, 0.5) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in corpus()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)
