import random

import pytest

WORDS = "the of and to in ein und der la les de para con año être über thing ABC x1 42 Zoë".split()


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "###", "\n", "'s", " token = \"abcdef0123456789abcd\""]))
    return " ".join(out)


@pytest.fixture(scope="session")
def doc_rows():
    """Texts with copies, near copies, shared lines, ties, nulls, empties and a very long one."""
    rng = random.Random(7)
    shared = "a passage of more than twenty characters that repeats"
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice([1, 3, 8, 40, 120]))
        if i % 4 == 0:
            text = f"{text}\n  {shared.upper() if i % 8 else shared}\t\n{prose(rng, 5)}"
        rows.append((i, text, "en" if i % 2 else "fr", f"src{i % 3}", len(text)))
    base = " ".join(rng.choice(WORDS) + str(k) for k in range(200))
    for k in range(25):  # near copies, in a chain
        words = base.split()
        words[3 + 2 * k] = f"other{k}"
        rows.append((100 + k, " ".join(words), "en", "src0", 0))
    rows += [(200 + k, base, "en", "src0", 0) for k in range(10)]
    rows += [
        (300, None, None, None, None), (301, "", "en", "src1", 0), (302, " \n\n ", "en", "src1", 4),
        (303, "one two three", "en", "src1", 13), (304, "one two three", "de", "src2", 13),
        (305, prose(rng, 20000), "en", "src0", None), (306, "x" * 50000, "en", "src0", None),
        (307, "AKIA" + "A1" * 10 + " AKIAshort AKIA" + "Z" * 13 + " password: 'hunter2hunter2' secret=short apikey=\"" + "k" * 12, "en", "s", 1),
        (308, "é" * 30 + " token=deadbeefdeadbeef01 𝄞𝄞 deadbeefdeadbeef", "fr", "s", 1),
        (309, "token: \"secret\" = \"abcdefghijklmnop\" " + "0123456789abcdef" * 3, "fr", "s", 1),
        (310, "<|endoftext|> hello <|startoftext|>World It's we'll d'accord ²³ Å ﬁ ẞ İ", "en", "s", 1),
        (5, rows[5][1], "en", "src2", 1), (5, rows[5][1], "en", "src2", 1),  # a row that repeats
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """The rows with further columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, h array<int>, words string, n int, part int, batch int"
    return spark.createDataFrame([(*r, "x", 1, [1], "w", 2, 3, 4) for r in doc_rows], schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < 0")
