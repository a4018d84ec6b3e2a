"""Small tables with the awkward rows that every operator must handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, schema=DOCS):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, schema)


def prose(n, seed=1):
    """n pseudo-words, no two runs alike."""
    import random
    draw = random.Random(seed)
    parts = "an er on the re in ti es or st en at to nd ha is".split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(n))


AWKWARD = [None, "", " ", "\n\t", "a", "one two", "é日本␛ \U0001f600", "x" * 50_000, prose(3_000), prose(3_000)]
