import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

LONG = "passage of words that go on " * 3000
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the quick  brown\tfox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b "),
    (6, "one two"),
    (7, "One TWO"),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "mail me: a.b@c.de_f@g.hi, ip 10.0.0.255 and 10.0.0.256.1.2, card 4111 1111 1111 1111 call +1 (619) 555-0053."),
    (11, "x" * 9000 + " é☃ <|endoftext|> " + "ab!?" * 3000 + " don't"),
    (12, "a b c a b c a b c\nline\nline\n\n#*$ done \u2581\U0010ffff \x85\u00a0."),
    (12, "a b c a b c a b c\nline\nline\n\n#*$ done \u2581\U0010ffff \x85\u00a0."),
    (None, "one two"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 4 else "h", "x", 1, 2) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept string, n_words int, _id int").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
