"""Small documents with what can go wrong, and brute-force twins."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=None):
    pick = vocabulary or ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(pick) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty and white-space texts, a long one, repeated rows and ids."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    copy = prose(rng, 120)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 6), (4, long, "en", "b", len(long)),
        (5, copy, "en", None, 10), (6, copy, "fr", "b", 10), (6, copy, "fr", "b", 10), (6, prose(rng, 50), "fr", "b", 10),
        (None, copy, "de", "c", 1), (None, None, None, None, None), (7, "Ünï Çödé\x00 word \U0001f600 <|endoftext|> end", "es", "é", 9), (8, "one two", "en", "a", 7),
    ]


def clashing(df):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("fp", "h", "th", "size", "score", "keep", "n_words", "ranges", "items", "spans", "component", "unit", "copies", "threshold", "_key", "key")})


def components_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
