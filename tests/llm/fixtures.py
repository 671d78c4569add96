"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 97) for i in range(20_000))
CLASHING = "key long, n int, at int, id long, found string, score string, rejected string, place string, label string, component_id long, shard int, bits long"


def rows():
    base = " ".join(WORDS)
    texts = [None, "", " \t ", "\n\n", "word", base, base, base.upper(), base.replace("omega", "end"), LONG, LONG + " tail", "é ß 日本語 😀", "12 34 !!", "password = aaaaBBBB1234cccc\nplain line of seven words is here\nplain line of seven words is here"]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base), (None, None)]


def docs(spark, data=None):
    data = rows() if data is None else data
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    full = [(d, t, "en" if d is not None and d % 2 else None, "s", len(t or ""), 1, 2, 3, 4, "f", "s", "r", "p", "l", 5, 6, 7) for d, t in data]
    return spark.createDataFrame(full, schema)
