"""Secret scans: three kinds of spans by pattern, and more by two character Markov models.

The spans of the patterns and the ordinary long words beside them are the labelled samples from
which the models of random strings and of ordinary identifiers are counted; a further run of key
characters is a secret if its log-likelihood ratio outweighs the prior odds.  Everything is a
projection over the texts, with DataFrame functions alone; only the sample's character pairs,
at most 2 x 128 x 128 counts, are brought together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds, the group that has the value, and its least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),  # a shorter run can't hold a longer one
}
MARKOV = "markov"
#: A run that the models judge, and its shorter form that trains the model of ordinary identifiers.
RUN, ORDINARY = r"([A-Za-z0-9+/_=-]{20,})", r"([A-Za-z0-9+/_=-]{8,})"
#: Most documents whose spans and words train the models, and the odds against a run being a secret.
SAMPLE_DOCS, PRIOR_ODDS = 20_000, 1e4
_CODES = 128
_SPAN = "array<struct<start: int, order: int, kind: string, end: int, value: string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def spans(text: Column, kind: str, order: int, pattern: str, least: int) -> Column:
    """Leftmost non-overlapping matches (start, order, kind, end, value), in code points, whose value is long enough.

    The text before each match is matched along with it, anchored at the end of the last one, so
    that lengths alone give the places."""
    whole = rf"(?s)\G(.*?)({pattern})"
    before, hit, value = (F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (1, 2, 3))
    each = F.arrays_zip(F.transform(before, F.length).alias("before"), F.transform(hit, F.length).alias("hit"), value.alias("value"))
    none = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (start + x["hit"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["hit"]).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(each, none, add)["found"]
    return F.when(text.rlike(pattern), found).otherwise(_none())


def base_spans(text: Column) -> Column:
    """The spans of all three kinds by start and then kind."""
    each = [spans(text, kind, i, pattern, least) for i, (kind, (pattern, _, least)) in enumerate(BASE.items())]
    return F.array_sort(F.concat(*each))


def _pair_counts(docs: DataFrame, text_col: str, sample_docs: int) -> DataFrame:
    """(secret, before, after, n): character pairs of the sample's labelled strings."""
    rows = docs.count()
    key = F.xxhash64(text_col)
    some = docs.where(F.pmod(key, F.lit(max(1, math.ceil(rows / sample_docs)))) == 0).select(F.col(text_col).alias("text")).where("text is not null")
    found = some.select("text", base_spans(F.col("text")).alias("base"))
    values = F.transform("base", lambda s: s["value"])
    words = F.array_except(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(1)), values)
    labelled = found.select(F.explode(values).alias("word"), F.lit(True).alias("secret")).unionByName(found.select(F.explode(words).alias("word"), F.lit(False).alias("secret")))
    pairs = labelled.select("secret", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).where("length(word) > 1")
    code = lambda at: F.ascii(F.substring(F.col("word"), at, F.lit(1)))
    return pairs.groupBy("secret", code(F.col("at")).alias("before"), code(F.col("at") + 1).alias("after")).agg(F.count("*").alias("n"))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """log P(after | before, random) - log P(after | before, ordinary) at before * 128 + after, add-one smoothed."""
    counts = {True: {}, False: {}}
    for secret, before, after, n in _pair_counts(docs, text_col, sample_docs).collect():  # 2 x 128 x 128 rows at most
        if before < _CODES and after < _CODES:
            counts[secret].setdefault(before, {})[after] = n
    alphabet = 66  # of RUN, with the dot

    def log_p(table: dict, before: int, after: int) -> float:
        row = table.get(before, {})
        return math.log((row.get(after, 0) + 1) / (sum(row.values()) + alphabet))

    seen = sorted(set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."))
    ratios = [0.0] * (_CODES * _CODES)
    for x in map(ord, seen):
        for y in map(ord, seen):
            ratios[x * _CODES + y] = log_p(counts[True], x, y) - log_p(counts[False], x, y)
    return ratios


def log_ratio(word: Column, ratios: Column) -> Column:
    codes = F.transform(F.split(word, ""), F.ascii)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda x, y: x * _CODES + y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, at: acc + F.coalesce(F.get(ratios, at), F.lit(0.0)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, prior_odds: float = PRIOR_ODDS) -> DataFrame:
    """(doc_id, base, added): the spans by pattern and those that the models add, one row for each row of docs.

    A null text counts as empty and has no spans.  An added span meets no span by pattern.
    Repeated rows and null ids are scanned like any other; other columns are ignored; an empty
    table gives no rows, and without labelled strings the models are even and add nothing."""
    literal = ",".join(f"{r:.6g}" for r in train(docs, text_col, sample_docs))
    ratios = F.from_json(F.lit(f"[{literal}]"), "array<double>")  # folded into a constant
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.select("doc_id", base_spans(F.col("text")).alias("base"), spans(F.col("text"), MARKOV, len(BASE), RUN, 1).alias("runs"))
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    found = found.select("doc_id", "base", apart.alias("runs"))
    return found.select("doc_id", "base", F.filter("runs", lambda r: log_ratio(r["value"], ratios) > math.log(prior_odds)).alias("added"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the three kinds, the hash of the spans by pattern, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
