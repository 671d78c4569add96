"""Line deduplication by an exact set-similarity join.

Every line is the set of its words.  Equal lines are one class from the start.  The words of a set
are ordered by rarity, and two sets can only be similar if they share a word of their prefixes at
places from which enough words are left and if their sizes allow it; what passes is verified on
the full sets.  Rarity is read from hashed word counts of the whole corpus, of fixed size, so that
ordering the words takes no shuffle; any one order of all words gives the same result.

A line only has to be similar to one earlier line.  So each is held first against the earliest
line of those that share two neighbouring rare words with it, which settles nearly all of a group
of near copies; pairs of two settled lines aren't looked at any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import NEAR_PERCENT, Scratch, sized_broadcast

#: Words of the shortest line that is compared if nothing else is asked for, and where every line with a word is.
LEAST_WORDS, EVERY_LINE = 5, 1
#: Counters that the words' hashes share, a power of two, and how finely their logarithms are told apart.
COUNTERS, STEPS = 1 << 16, 3
#: Pairs of neighbouring rare words by which a line meets the lines that it is held against first.
PIVOT_KEYS = 3
#: Lines that a line must be the earliest of before it is held against all that share a rare word with it.
HEAD_MET = 8
#: The part of a set, its rarest words, by which pairs are compared before their whole sets are.
HEAD = 6
#: Distinct words beyond which a line's bits are in four maps of 64 rather than in two.
LONG_LINE = 128
#: Most numbers that a broadcast table of removed lines has.
BROADCAST_LINES = 2_000_000
#: Most lines asked for whose texts are picked by a broadcast before they are cut into lines.
NAMED_LINES = 1_000_000
_HASH_BITS = 56
_BLANKS = "\t\x0b\x0c\r"
_LEFT_BITS = 32


def _row_key(text_col: str) -> Column:
    """With the id, what tells a row's lines from those of others."""
    return F.xxhash64(text_col)


def _lines(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(doc_id, key, at, line) of the lines that have a word and may be long enough, in lower case with spaces alone between words."""
    odd = F.lit(False)
    for blank in _BLANKS:
        odd = odd | F.contains(text_col, F.lit(blank))
    even = F.lower(F.when(odd, F.translate(text_col, _BLANKS, " " * len(_BLANKS))).otherwise(F.col(text_col)))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _row_key(text_col).alias("key"), F.posexplode(F.split(even, "\n")).alias("at", "line"))
    return rows.where((F.length("line") >= 2 * least_words - 1) & (F.ltrim("line") != ""))


def _counter(h: Column, counters: int) -> Column:
    """The counter, one of a power of two, by a hash's low bits."""
    return h.bitwiseAND(F.lit(counters - 1)).cast("int")


def _rarities(lines: DataFrame, counters: int) -> bytes:
    """A byte for each counter that grows with the logarithm of the words counted there."""
    words = lines.select(F.explode(F.split("line", " ")).alias("word"))
    counts = words.groupBy(_counter(F.xxhash64("word"), counters).alias("counter")).agg(F.count("*").alias("n"))
    every = counts.unionByName(lines.sparkSession.range(counters).select(F.col("id").cast("int").alias("counter"), F.lit(0).cast("long").alias("n")))
    ranks = every.groupBy("counter").agg(F.sum("n").alias("n")).select("counter", F.least(F.lit(127), F.round(STEPS * F.log2(F.col("n") + 1))).cast("int").alias("rank"))
    ordered = F.array_sort(F.collect_list(F.struct("counter", "rank")))  # of fixed size
    return bytes(ranks.agg(F.unhex(F.array_join(F.transform(ordered, lambda x: F.lpad(F.hex(x["rank"]), 2, "0")), ""))).first()[0])


def line_set(line: Column, rarities: bytes) -> Column:
    """The distinct words as numbers whose order is that of rarity: the counter's byte before 56 bits of hash."""
    ranks = F.from_json(F.lit(f"[{','.join(map(str, rarities))}]"), "array<tinyint>")  # folded into a constant

    def number(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, _counter(h, len(rarities))), F.lit(0))  # never null, so that Spark sorts plain numbers
        return F.shiftleft(rank.cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS))

    words = F.transform(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), number)
    return F.sort_array(F.array_remove(F.array_distinct(words), number(F.xxhash64(F.lit("")))))


def prefix_size(n: Column, percent: int) -> Column:
    """Words of which similar sets share one: n - ceil(t n) + 1."""
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _ordered(lines: DataFrame) -> DataFrame:
    """lines with place: one number in the order of doc_id (null last) and at."""
    low, high, most = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("at")).first()
    low, high, most = low or 0, high or 0, most or 0
    kind = "long" if (high - low + 2) * (most + 1) < 1 << 63 else "decimal(38,0)"
    after = F.coalesce(F.col("doc_id").cast(kind) - F.lit(low).cast(kind), F.lit(high - low + 1).cast(kind))
    return lines.withColumn("place", (after * F.lit(most + 1).cast(kind) + F.col("at").cast(kind)).cast(kind))


def _pivots(lines: DataFrame) -> DataFrame:
    """(a, b): each line and the earliest of those that share a pair of neighbouring words of their prefixes with it."""
    keys = [F.xxhash64(F.get("prefix", F.lit(i)), F.coalesce(F.get("prefix", F.lit(i + 1)), F.lit(i))) for i in range(PIVOT_KEYS)]
    some = F.slice(F.array(*keys), F.lit(1), F.greatest(F.lit(1), F.least(F.lit(PIVOT_KEYS), F.size("prefix") - 1)))
    rows = lines.select("line_id", "place", F.explode(some).alias("pair"))
    firsts = rows.groupBy("pair").agg(F.min_by("line_id", "place").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.select("pair", F.col("line_id").alias("b")).join(firsts, "pair").where("a <> b").select("a", "b").distinct()


def _prefix_rows(lines: DataFrame, *more: str) -> DataFrame:
    """(word, line_id, *_MAPS, held, *more): a row for each word of the prefixes; size, rest and openness travel in one number.

    The word is a hash of the word's number: a chance meeting only adds a pair to verify."""
    words = lines.select("line_id", "n", *_MAPS, "open", *more, F.posexplode("prefix").alias("at", "word"))
    held = F.shiftleft(F.col("n").cast("long"), _LEFT_BITS).bitwiseOR(2 * (F.col("n") - F.col("at")).cast("long")).bitwiseOR(F.col("open").cast("long"))
    return words.select("word", "line_id", *_MAPS, held.alias("held"), *more)


def _may_be_similar(percent: int) -> Column:
    """The length, positional and bit filters on prefix rows x and y.

    Of similar sets the shared words are at least t / (1 + t) of the sizes' sum.  They are at most
    what is left from the first shared word on, and the words of one set alone are at least the
    bits of one set alone."""
    n = lambda side: F.shiftrightunsigned(F.col(f"{side}.held"), _LEFT_BITS)
    left = lambda side: F.shiftrightunsigned(F.col(f"{side}.held").bitwiseAND(F.lit((1 << _LEFT_BITS) - 1)), 1)
    sizes = 100 * F.least(n("x"), n("y")) >= percent * F.greatest(n("x"), n("y"))
    places = (100 + percent) * F.least(left("x"), left("y")) >= percent * (n("x") + n("y"))
    both = lambda side, c: F.col(f"{side}.{c}").bitwiseOR(F.col(f"{side}.{c}_2"))
    apart = sum(F.bit_count(both("x", c).bitwiseXOR(both("y", c))) for c in ("low", "high"))
    apart = F.when((n("x") > LONG_LINE) & (n("y") > LONG_LINE), sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _MAPS)).otherwise(apart)
    return sizes & places & ((100 + percent) * apart <= (100 - percent) * (n("x") + n("y")))


def _with_heads(lines: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """pairs (a, b), and each line with the earlier ones of their most met `a` that share a word of its prefix."""
    heads = scratch.table(pairs.groupBy("a").agg(F.count("*").alias("met")).where(F.col("met") >= HEAD_MET).select(F.col("a").alias("line_id")))
    marked = lines.withColumn("open", F.lit(True))
    y = _prefix_rows(marked.join(sized_broadcast(heads, heads.count()), "line_id", "left_semi"), "place")
    x, y = _prefix_rows(marked, "place").alias("x"), sized_broadcast(y, heads.count() * 50).alias("y")
    met = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("y.place") < F.col("x.place")) & _may_be_similar(percent))
    return pairs.unionByName(met.select(F.col("y.line_id").alias("a"), F.col("x.line_id").alias("b"))).distinct()


def _candidates(lines: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of lines (line_id, n, *_MAPS, prefix, open), one of them open, that share a word of their prefixes and may be similar."""
    words = _prefix_rows(lines)
    x, y = words.alias("x"), words.alias("y")
    either = F.col("x.held").bitwiseOR(F.col("y.held")).bitwiseAND(F.lit(1)) == 1
    near = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.line_id") < F.col("y.line_id")) & either & _may_be_similar(percent))
    return near.select(F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b")).distinct()


_MAPS = ("low", "high", "low_2", "high_2")


def _maps(members: Column) -> list[Column]:
    """Maps of 64 bits in which each number sets one: by one more of its bits it is in low or high, and in a long line, by another one, in that or its second one."""
    long_line = F.size(members) > LONG_LINE

    def of(which: int) -> Column:
        second, high = divmod(which, 2)

        def bit(m: Column) -> Column:
            own = F.shiftrightunsigned(m, 6).bitwiseAND(F.lit(1))
            return F.call_function("shiftleft", own if high else F.lit(1) - own, m.bitwiseAND(F.lit(63)).cast("int"))

        among = lambda m: m.bitwiseAND(F.lit(128)) == 128 * second
        part = F.aggregate(members, F.lit(0).cast("long"), lambda acc, m: F.when(among(m), acc.bitwiseOR(bit(m))).otherwise(acc))
        whole = F.lit(0).cast("long") if second else F.aggregate(members, F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(bit(m)))
        return F.when(long_line, part).otherwise(whole)

    return [of(i).alias(name) for i, name in enumerate(_MAPS)]


def _sets(docs: DataFrame, id_col: str, text_col: str, least_words: int, lines: DataFrame, ids: DataFrame, rarities: bytes, scratch: Scratch) -> DataFrame:
    """(line_id, members) of the lines asked for, read again from the texts that have some; rows that repeat have them once."""
    named = scratch.table(lines.join(ids, "line_id", "left_semi").select("line_id", F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), F.col("at").alias("of_at")))
    met = (F.col("key") == F.col("of_key")) & (F.col("at") == F.col("of_at")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    rows = named.count()
    some = docs.select(id_col, text_col)
    if rows <= NAMED_LINES:  # beyond, texts aren't shuffled for it
        of_texts = F.broadcast(named.select("of_doc", "of_key").distinct())
        some = some.join(of_texts, (_row_key(text_col) == F.col("of_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("of_doc")), "left_semi")
    asked = _lines(some, id_col, text_col, least_words).join(sized_broadcast(named, rows), met).groupBy("line_id").agg(F.min("line").alias("line"))
    return scratch.table(asked.select("line_id", line_set(F.col("line"), rarities).alias("members")))


def _similar(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs (earlier, later) of similar sets."""
    of = lambda x: full.select(F.col("line_id").alias(x), F.col("members").alias(f"of_{x}"))
    both = F.size(F.array_intersect("of_earlier", "of_later"))
    similar = 100 * both >= percent * (F.size("of_earlier") + F.size("of_later") - both)
    return pairs.join(of("earlier"), "earlier").join(of("later"), "later").where(similar).select(F.col("later").alias("line_id")).distinct()


def later_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", percent: int = NEAR_PERCENT, counters: int = COUNTERS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, key, at): the lines, by the row's id and key and the line's place from 0, that are similar to an earlier line.

    Lines are ordered by doc_id (null last), then by place; rows that share an id but not the text
    come in any one order."""
    texts = _lines(docs, id_col, text_col, least_words)
    rarities = _rarities(texts, counters)
    sets = texts.select("doc_id", "key", "at", line_set(F.col("line"), rarities).alias("members"))
    prefix = F.transform(F.slice("members", F.lit(1), prefix_size(F.size("members"), percent)), lambda m: F.hash(m))
    lines = scratch.table(sets.select(F.monotonically_increasing_id().alias("line_id"), "doc_id", "key", "at", F.xxhash64("members").alias("class"), F.size("members").alias("n"), *_maps(F.col("members")), prefix.alias("prefix")))
    lines = _ordered(lines.where(F.col("n") >= least_words))

    narrow = lines.select("line_id", "class", F.xxhash64(*_MAPS, "n").alias("also"), "place", "key")
    firsts = narrow.groupBy("class", "also").agg(F.min_by("line_id", "place").alias("first"), F.min_by("key", "place").alias("first_key"), F.min("place").alias("least"), F.count("*").alias("lines")).where("lines > 1")
    # one line stands for its class; rows that repeat share its place, and their lines are no later ones
    same = scratch.table(narrow.join(firsts, ["class", "also"]).where("line_id <> first").select("line_id", ((F.col("place") != F.col("least")) | (F.col("key") != F.col("first_key"))).alias("later")))
    distinct = lines.join(sized_broadcast(same.select("line_id"), same.count()), "line_id", "left_anti")

    ids = lambda of, x, y: of.select(F.col(x).alias("line_id")).unionByName(of.select(F.col(y).alias("line_id"))).distinct()
    pairs = scratch.table(_with_heads(distinct, scratch.table(_pivots(distinct)), percent, scratch))
    full = _sets(docs, id_col, text_col, least_words, lines, ids(pairs, "a", "b"), rarities, scratch)
    settled = scratch.table(_similar(pairs.select(F.col("a").alias("earlier"), F.col("b").alias("later")), full, percent))
    scratch.drop(full, pairs)

    mark = sized_broadcast(settled.select("line_id", F.lit(True).alias("settled")), settled.count())
    rest = distinct.join(mark, "line_id", "left").select("line_id", "n", *_MAPS, "prefix", F.col("settled").isNull().alias("open"))
    near = scratch.table(_candidates(rest, percent))
    of = scratch.table(lines.join(ids(near, "a", "b"), "line_id", "left_semi").join(mark, "line_id", "left").select("line_id", "place", "n", F.slice("prefix", F.lit(1), F.ceil(F.col("n") / HEAD).cast("int")).alias("head"), F.col("settled").isNotNull().alias("settled")))
    directed = scratch.table(_directed(near, of, percent))
    full = _sets(docs, id_col, text_col, least_words, lines, ids(directed, "earlier", "later"), rarities, scratch)
    # a line that is similar to its earliest candidate needs no other
    first = scratch.table(_similar(directed.groupBy("later").agg(F.min_by("earlier", "place").alias("earlier")), full, percent))
    others = directed.select("earlier", "later").join(first.select(F.col("line_id").alias("later")), "later", "left_anti")
    later = same.where("later").select("line_id").unionByName(settled).unionByName(first).unionByName(_similar(others, full, percent))
    return lines.join(later, "line_id", "left_semi").select("doc_id", "key", "at")


def _directed(pairs: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """(earlier, later, place) of the pairs (a, b) whose later line isn't settled and whose rarest words allow the similarity.

    Shared are these that both have, and at most all that lie behind them in one set."""
    side = lambda x: of.select(F.col("line_id").alias(x), F.struct("place", F.col("line_id").alias("id"), "settled", "n", "head").alias(f"of_{x}"))
    behind = lambda x: F.col(f"of_{x}.n") - F.size(f"of_{x}.head")
    most = F.size(F.array_intersect("of_a.head", "of_b.head")) + F.greatest(behind("a"), behind("b"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * most >= percent * (F.col("of_a.n") + F.col("of_b.n")))
    turned = (F.col("of_a.place") > F.col("of_b.place")) | ((F.col("of_a.place") == F.col("of_b.place")) & (F.col("a") > F.col("b")))
    later = lambda c: F.when(turned, F.col(f"of_a.{c}")).otherwise(F.col(f"of_b.{c}"))
    earlier = lambda c: F.when(turned, F.col(f"of_b.{c}")).otherwise(F.col(f"of_a.{c}"))
    return met.select(earlier("id").alias("earlier"), later("id").alias("later"), earlier("place").alias("place"), later("settled").alias("_settled")).where("not _settled").drop("_settled")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = NEAR_PERCENT, counters: int = COUNTERS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns of docs, the text without its later lines, and line_count and removed_lines after them.

    A line of at least `least_words` distinct words (1 for all lines but blank ones) goes if an
    earlier one of them has a Jaccard similarity of `percent` or more, whether that one is kept or
    not; other lines stay.  Words are split at white space and compared in lower case.  A null text stays null, with no lines;
    a text whose lines all go becomes empty; a very long text is one row, its lines are rows of their own.  Rows that repeat both id and text share one
    decision.  A null id comes last in the order.  Columns of docs with the added names are
    replaced.  An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    gone = later_lines(docs, scratch, id_col, text_col, percent, counters, least_words)
    removed = gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("gone"))  # as many as a text has lines
    removed = scratch.last(removed.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "gone"))
    size = removed.agg(F.count("*") * 4 + F.sum(F.size("gone"))).first()[0] or 0
    own = docs.drop("line_count", "removed_lines")
    met = own.join(sized_broadcast(removed, size, BROADCAST_LINES), F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (_row_key(text_col) == F.col("_key")), "left")
    met = met.withColumn("_every", F.split(text_col, "\n"))  # a column of its own, or each line kept would split the text again
    every = F.col("_every")
    keep = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone")), lambda i: F.get(every, i))
    text = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n"))
    counts = {"line_count": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(every)), F.lit(0)), "removed_lines": F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))}
    return met.withColumns(counts | {text_col: text}).select(*[F.col(f"`{c}`") for c in own.columns], "line_count", "removed_lines")
