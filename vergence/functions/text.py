"""Text functions as column expressions: tokens, chunks, masks, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make a pair of characters no term.
STOP_CHARS = "的了呢吧啊吗么呀哦嘛啦是在有和与及或对其被把让跟请问我你您他她它这那个哪些怎么怎样如何多少还就也很都最太挺不没会把要能可以"
# A line of a short field name, a colon and a value.
FIELD_LINE = r"^[一-龥A-Za-z0-9 ]{1,12}\s*[:：]\s*\S.{0,200}$"
SENTENCE_END, CLAUSE_END = "[。；;]", "[，,、]"
LONG_SENTENCE, LEAST_CHUNK = 40, 2
# Where lines end, and the blanks around them, full-width and no-break ones among them.
LINE_ENDS, BLANKS = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", " \t\r\x0b\x0c\n\x1c\x1d\x1e\x1f\x85\xa0\u2000\u2001\u2002\u2003\u2009\u2028\u2029\u3000"
_MARK = "\x01"
# Marks that a question key drops at its end, and full-width marks with their half-width forms.
TRAILING_MARKS = "？?！!。，、；;.,"
WIDE_MARKS, NARROW_MARKS = "，。！？；：、（）～", ",.!?;:,()~"
# Rings of words that replace each other in turn, then pairs; an earlier rule for a word hides a later one.
SYNONYM_RINGS = (
    ("保修", "质保", "三包"), ("运费", "邮费"), ("退货", "退换"), ("发货", "出库"), ("净含量", "容量"), ("物流", "快递"), ("规格", "参数"), ("保质期", "保存期"),
    ("评论", "评价"), ("客服", "售后"), ("优惠", "折扣"), ("发票", "收据"), ("保温杯", "保温瓶"), ("味道", "口感"), ("秒杀", "闪购"), ("账号", "账户"), ("折扣券", "优惠券"),
    ("刻字", "雕字"), ("上市年份", "哪一年出"), ("上班", "开门"), ("配送", "寄出"), ("保修", "给修"), ("发票", "票据"), ("退换", "退掉"), ("运费", "邮资"), ("保温杯", "保温壶"),
)


def tokens(text: Column) -> Column:
    """All tokens: ASCII letter or digit runs in lower case, and pairs of other letters between them.

    Of the characters between two ASCII runs only letters and digits count; a single one is a
    token of its own, and tokens with a stop character are left out.  The text becomes tokens with
    marks between them by replacements alone, so that it is read as a whole and not run by run."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    apart = F.regexp_replace(F.translate(text, upper + _MARK, upper.lower()), "[a-z]+|[0-9]+", f"{_MARK}$0{_MARK}")
    letters = F.regexp_replace(apart, rf"[^\p{{L}}\p{{N}}{_MARK}]+", "")
    pairs = F.regexp_replace(letters, r"(?<=[^\x00-\x7F])([^\x00-\x7F])(?=[^\x00-\x7F])", f"$1{_MARK}$1")
    # only Chinese text can have a stop character
    kept = F.when(text.rlike("[一-龥]"), F.regexp_replace(pairs, f"[^{_MARK}]?[{STOP_CHARS}][^{_MARK}]?", "")).otherwise(pairs)
    return F.array_remove(F.split(kept, f"{_MARK}+"), "")


def terms(text: Column) -> Column:
    """The distinct tokens."""
    return F.array_distinct(tokens(text))


def normalised(text: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _sentence(s: Column) -> Column:
    parts = F.filter(F.transform(F.split(s, CLAUSE_END), stripped), lambda p: F.length(p) >= LEAST_CHUNK)
    short = F.when(F.length(s) >= LEAST_CHUNK, F.array(s)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(s) <= LONG_SENTENCE, short).when(F.size(parts) > 0, parts).otherwise(F.array(s))


def document_chunks(text: Column, most: int | None = None) -> Column:
    """Evidence chunks: a field line whole, other lines by sentence and a long sentence by clause; all of them, or the first `most` of a document."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), stripped), lambda x: x != "")
    sentences = lambda line: F.transform(F.split(line, SENTENCE_END), lambda s: F.trim(stripped(s), F.lit("，,、")))
    chunks = F.transform(lines, lambda line: F.when(line.rlike(FIELD_LINE), F.array(line)).otherwise(F.flatten(F.transform(sentences(line), _sentence))))
    return F.flatten(chunks) if most is None else F.slice(F.flatten(chunks), 1, most)


def dialogue_chunks(text: Column, most: int | None = None) -> Column:
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), stripped), lambda x: F.length(x) >= LEAST_CHUNK)
    return lines if most is None else F.slice(lines, 1, most)


def masked(text: Column) -> Column:
    """E-mail names of three or more characters, then 11-digit mobile numbers, are starred out; a second pass changes nothing."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]{3,}@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "****@$1")
    return F.regexp_replace(mail, r"(?<!\d)(1)[3-9]\d{7}(\d{2})(?!\d)", "$1********$2")


def contact_masked(text: Column) -> Column:
    """Any e-mail, then any run of digits, blanks, hyphens and dots with seven digits or more, are starred out."""
    mail = F.regexp_replace(text, r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)", "****@$1")
    runs = F.regexp_extract_all(mail, F.lit(r"\d[\d \t\-.]*\d|(?:(?!\d[\d \t\-.]*\d)[\s\S])+"), F.lit(0))

    def star(run: Column) -> Column:
        digits = F.regexp_replace(run, r"\D", "")
        number = run.rlike(r"^\d[\d \t\-.]*\d$") & (F.length(digits) >= 7)
        return F.when(number, F.concat(F.substring(digits, 1, 1), F.repeat(F.lit("*"), F.length(digits) - 3), F.substring(digits, -2, 2))).otherwise(run)

    return F.array_join(F.transform(runs, star), "")


def question_key(text: Column) -> Column:
    """Trimmed, full-width marks made narrow, marks at the end dropped."""
    return F.rtrim(F.translate(stripped(text), WIDE_MARKS, NARROW_MARKS), F.lit(TRAILING_MARKS))


def rotated_synonyms(text: Column) -> Column:
    """One scan from the left, the longest word first: each word of a ring becomes the next of its ring."""
    rules: dict[str, str] = {}
    for ring in SYNONYM_RINGS:
        for word, following in zip(ring, ring[1:] + ring[:1]):
            rules.setdefault(word, following)
    pattern = "|".join(sorted(rules, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(rf"{pattern}|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def price_label(cents: Column, currency: Column) -> Column:
    """Cents as an amount without trailing zeros, with its unit; no price, no amount."""
    amount = F.rtrim(F.rtrim(F.format_string("%.2f", cents / 100), F.lit("0")), F.lit("."))
    code = F.upper(F.coalesce(currency, F.lit("CNY")))
    return F.when(cents.isNull(), "价格未定").when(code == "CNY", F.concat(amount, F.lit("元"))).otherwise(F.concat_ws(" ", amount, code))


def order_number(text: Column) -> Column:
    """The first order number, in upper case; null without one."""
    found = F.upper(F.regexp_extract(text, r"(?i)SO-\d+", 0))
    return F.when(found != "", found)


def shortened(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def longest_common(a: Column, b: Column) -> Column:
    """The first longest piece of a that is in b ('' if they share none)."""
    n = F.length(a)
    sized = lambda k: F.filter(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(a, i, k)), lambda s: F.contains(b, s))
    best = F.filter(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.get(sized(k), F.lit(0))), lambda s: s.isNotNull())
    return F.when(n > 0, F.coalesce(F.get(best, F.lit(0)), F.lit(""))).otherwise("")
