"""Small tables with every awkward row, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def sentence(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, extra=()):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, texts in several scripts."""
    rnd = random.Random(5)
    long_text = "\n".join(sentence(rnd, 60) for _ in range(150))
    base = "Is the of and to in it that for with " + sentence(rnd, 80)
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, base, "en", "a", 1), (4, base, "en", None, 1), (4, base, "en", None, 1),
        (5, base + " tail", None, "b", 1), (None, base, "en", "b", 1), (None, "lonely words", "en", "c", 1), (6, long_text, "en", "c", 1), (7, long_text + "\nend", "en", "c", 1),
        (8, "Größe été 한국어 😀 naïve\nGröße été 한국어 😀 naïve", "de", "é", 1), (9, "one", "en", "z", 1), (10, "x" * 300, "en", "z", 1), (11, "x" * 300, "en", "z", 1),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with columns named like an operator's own."""
    from pyspark.sql import functions as F

    for name in ("id", "key", "row", "n", "words", "text_", "component", "component_id", "kept", "size", "target", "copies", "a", "b"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def classes(sets, percent):
    """doc -> smallest doc reachable over links of ``percent`` per cent or more."""
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}
