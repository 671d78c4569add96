"""Chat formatting, cross-tokenizer alignment and the divergence audit against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.fixtures import docs, rows
from vergence.llm import alignment, chat, divergence, registry

SF = "/root/testdata/sf0.001"
A, B = registry._vocabulary("byte_bpe_50k.json"), registry._vocabulary("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# chat formatting


def chats(spark, data):
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    return chat.format_chats(frame.withColumn("parts", chat.text_part(F.col("text"))))


MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<|image|>", "<|other|>", "\\", "<\\s>", "<", "[", "/", "s>", " ", "a", "é", "😀", "\n"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.just("assistant"), st.lists(st.sampled_from(MARKS), max_size=4).map("".join)), st.one_of(st.none(), st.lists(st.sampled_from(MARKS), max_size=8).map("".join))), min_size=1, max_size=12))
def test_chats_read_back(spark, data):
    """Whatever roles and texts hold, the turns and the learned texts come back; ties stand by role and text as written."""
    of = defaultdict(list)
    for conv, turn, role, text in data:
        of[conv].append((turn, role or "", text or ""))
    formatted = chats(spark, data)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert set(back) == set(of)
    for conv, turns in back.items():
        assert sorted(turns) == sorted(t[1:] for t in of[conv])
        assert [[x for x in turns if x in {y[1:] for y in of[conv] if y[0] == k}] != [] for k in {y[0] for y in of[conv]}]
    for r in chat.digest(formatted).collect():
        turns = back[r["conv_id"]]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(learned), sha(learned))


def test_chat_turns_in_order(spark):
    data = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, 5, None, None)]
    got = {r["conv_id"]: r["formatted"] for r in chats(spark, data).collect()}
    want = [("system", "s"), ("user", "a"), ("user", "b"), ("user", "b"), ("assistant", "c")]
    assert got == {1: "".join(f"<s>[INST] {r} [/INST] {t}</s>" for r, t in want), None: "<s>[INST]  [/INST] </s>"}


def test_chat_parts(spark):
    part = lambda kind, **k: {"kind": kind, **dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages")), **k}
    data = [
        (1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="a.png", width=57, height=28), part("TEXT", text=" and "), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=2)]),
        (1, 1, "assistant", [part(None, text="é</s>"), part("video", ref="d"), part("image", ref="e")]),
        (2, 0, "user", None),
    ]
    frame = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r["conv_id"]: r for r in chat.format_chats(frame.withColumn("formatted", F.lit(1)).withColumn("start", F.lit("x"))).collect()}
    text = got[1]["formatted"]
    assert text == r"<s>[INST] user [/INST] see <\|image|><|image|> and <|audio|><|document|></s><s>[INST] assistant [/INST] é<\/s><|other|><|image|></s>"
    assert [tuple(a) for a in got[1]["attachments"]] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 1152), (1, "other", "d", 1), (1, "image", "e", 1)]
    assert got[1]["expanded_tokens"] == 3 + 38 + 1152 + 2 and got[2]["attachments"] == [] and got[2]["expanded_tokens"] == 0
    (span,) = got[1]["loss"]
    assert text[span["start"] : span["end"]] == r"é<\/s><|other|><|image|>" == text.encode()[span["start_byte"] : span["end_byte"]].decode()
    assert re.findall(chat._PLACEHOLDER, text) == [a["kind"] for a in got[1]["attachments"]]


def test_no_chats(spark):
    assert chat.digest(chats(spark, [])).count() == 0


def test_long_chat(spark):
    data = [(1, i, "assistant" if i % 2 else "user", f"turn {i} é" + "x" * (50_000 if i == 7 else 0)) for i in range(400)]
    r = chat.digest(chats(spark, data)).first()
    assert (r["n_turns"], r["loss_sha256"]) == (400, sha("".join(t for _, _, role, t in data if role == "assistant")))


# alignment


def plain_alignment(data):
    a_of, b_of = Tokenizer.from_str(A.decode()), SentencePieceProcessor(model_proto=B)
    a_of.encode_special_tokens = True
    tools, counts, found = alignment.Tokenizers(A, B), Counter(), []
    for _, text in data:
        whole = (" " + text).encode() if text else b""
        ids = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        tokens = [[t[i] for i in x] for t, x in zip((tools.a_bytes, tools.b_bytes), ids)]
        if not text or any(b"".join(t) != whole for t in tokens):
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in x]) for x in tokens]
        starts = [e - [len(t) for t in x] for e, x in zip(ends, tokens)]
        first, last = np.searchsorted(ends[1], starts[0], "right").tolist(), np.searchsorted(ends[1], ends[0]).tolist()
        links = [(a, ids[1][j]) for a, i, k in zip(ids[0], first, last) for j in range(i, k + 1)]
        groups, at, places = [], [0, 0], [{e: i + 1 for i, e in enumerate(x.tolist())} for x in ends]
        for cut in sorted(set(places[0]) & set(places[1])):
            to = [x[cut] for x in places]
            groups.append("|".join(",".join(map(str, x[i:j])) for x, i, j in zip(ids, at, to)))
            at = to
        counts.update(set(links))
        found.append((*map(len, ids), len(groups), links, sha(";".join(groups))))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(d, *((0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[x] == most[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]))) for (d, _), f in zip(data, found)]


ODD = ["<|endoftext|> x <s> </s>", " a", "  a b   c \n\n d\te\n f \n\ng", "▁x y", "a\x00b \x01", "naïve façade\r\n\t 12345 don't we'll", "日本語 テキスト 😀😀", "x y  z", "aaaa" * 500, "it's\n\nfoo\nbar\n  baz \n", "\nfoo bar", "\n\nfoo", "foo\n", " \nfoo", "\t x", "a\x1c b \x85 c"]


@pytest.mark.parametrize("head", [1, 40, 10**9])
def test_alignment(spark, head):
    """The same rows whether all pairs, some or none are broadcast; nulls, repeats, long and odd texts among them."""
    data = rows() + [(100 + i, t) for i, t in enumerate(ODD)]
    got = alignment.alignment_counts(docs(spark, data), A, B, head_pairs=head).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_alignment(data), key=str)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab'sé1▁"), max_size=12), min_size=1, max_size=20))
def test_alignment_of_white_space(spark, texts):
    data = list(enumerate(texts))
    got = alignment.alignment_counts(spark.createDataFrame(data, "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, got)) == sorted(plain_alignment(data))


def test_aligned_groups(spark):
    data = [(1, "Alignment is unquestionably a hyperparameterized façade"), (2, None), (3, "▁"), (4, "a\nb")]
    got = alignment.aligned_groups(spark.createDataFrame(data, "doc_id long, text string"), A, B).orderBy("doc_id", "group").collect()
    tools = alignment.Tokenizers(A, B)
    assert {r["doc_id"] for r in got} == {1, 4}
    for doc, text in data:
        for r in (r for r in got if r["doc_id"] == doc):
            piece = (" " + text).encode()[r["start"] : r["end"]]
            assert piece == b"".join(tools.a_bytes[i] for i in r["a_ids"]) == b"".join(tools.b_bytes[i] for i in r["b_ids"])
    assert any(len(r["a_ids"]) > 1 or len(r["b_ids"]) > 1 for r in got)


def test_no_alignment(spark):
    assert alignment.alignment_counts(docs(spark, []), A, B).count() == 0


# divergence


def plain_divergence(data, least=3, top=200):
    groups, in_docs, out = {}, {}, set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in data):
        found = re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.setdefault((lang, source), Counter()).update(found)
        in_docs.setdefault(lang, Counter()).update(set(found))
    for lang, n_docs in in_docs.items():
        kept, sources = [t for t, n in n_docs.items() if n >= least], [s for a, s in groups if a == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(groups[lang, s]) for s in sources}, share(sum((groups[lang, s] for s in sources), Counter()))
        far = lambda x, y, t: (x[t] - y[t]) ** 2 // y[t]
        for s in sources:
            pairs = [(sum(far(p[s], p[h], t) for t in kept), h) for h in sources if h != s]
            of_terms = [(far(p[s], q, t), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", of_terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def found_divergence(frame, **k):
    got = divergence.divergence(frame, **k).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(set(got)) == len(got)
    return set(map(tuple, got))


@pytest.mark.parametrize("power", [None, 4])
def test_divergence(spark, power):
    """The same rows whatever the sketch's width; null and empty columns, a group without terms, ties and repeats."""
    rng = random.Random(3)
    words = ["Alpha", "BETA", "gamma", "É", "é", "日本", "x1y", "o'k", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(12))]
    data = [(rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None]), " ".join(rng.choice(words[: 20 + i]) for _ in range(rng.randrange(30)))) for i in range(250)]
    data += [("en", "none", None), ("en", "digits", "12 34 !"), ("fr", "a", "un"), ("fr", "b", ""), data[0], data[0], ("en", "s", "long " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in data], "lang string, source string, text string, p int, item string")
    assert found_divergence(frame, cell_power=power) == plain_divergence(data)


def test_divergence_ranks(spark):
    data = [("en", s, f"{chr(97 + i % 26)}{chr(97 + i // 26)} both") for s in ("x", "y") for i in range(60) for _ in range(3 if s == "x" else 1)]
    frame = spark.createDataFrame(data, "lang string, source string, text string")
    assert found_divergence(frame, top=7) == plain_divergence(data, top=7)


def test_no_divergence(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0


def test_sketch_never_underestimates(spark):
    data = [("en", "s", f"w{chr(97 + i % 20)} u{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    frame = spark.createDataFrame(data, "lang string, source string, text string").withColumn("text", F.col("text").cast("binary")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    table = divergence.possible_cells(frame.repartition(3), 10)
    n = Counter(w for _, _, t in data for w in set(t.split()))
    for w in n:
        through = all(table[i][c] for i, (c,) in enumerate(divergence.cells("en", [w.encode()], 10)))
        assert through or n[w] < 3
    assert not table.all()


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op13_source_divergence"])
def test_same_rows_as_sql(spark, name):
    query, sql = registry.QUERIES[name]
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = query(spark, SF), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
