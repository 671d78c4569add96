"""Rules over one row: answer paths, checks of texts, fields to extract, lines of timelines and specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vergence.functions import text
from vergence.functions.fields import filled

# Fixed values.
CREDENTIAL = r"\s*·?\s*待确认\s*token=[0-9a-f]+"
QA_FIELD, IMAGE_FIELD = "qa_pairs", "图片描述"
HIGHLIGHT = "（切片高光）"
NO_SPECS = "（规格事实尚未写回，暂无可组装的治理口径）"
MOST_CHARS = 2000
LONGEST_SPAN, SHORTEST_SPAN = 4, 2
REVIEW_HEAD, QUESTION_HEAD, TITLE_MOST = 18, 30, 200
NO_TITLE = "未命名资产"
FIELD = r"^([一-龥A-Za-z0-9]{1,12}?)\s*[:：]\s*(\S.{0,200})$"
ENDINGS = (("是多少", "", "有多少"), ("是什么", "", "是多少"), ("怎么样", "请问", "值得入手吗"), ("吗", "", "，对吧"))
ELSE_ENDING = "，麻烦告知"
PICTURE_STOPS = "的了是在有和与及也就都还这那我你他她它请问一下一个什么怎么怎样多少哪吗呢吧啊呀哦嗯很挺太真个只把被给对能会要又没不"
PICTURE_PHRASES = (
    "画面", "背景", "图片", "照片", "图像", "主体", "居中", "清晰", "整体", "拍摄", "实拍", "一张", "这张", "下方", "上方", "中央", "中间", "可见", "呈现", "显示", "周围", "环境", "部分", "位置",
    "颜色", "色彩",
)
LEAST_SHARED = 2
PROPOSAL = r"(?is)TOOL:\s*(\w+)\s*(\{.*?\})"


def answer_path(kind: Column, generated: Column, tool: Column, rejected: Column) -> Column:
    """What an answer came from: refusal, llm, tool or template; a receipt or a rejected proposal is no tool's answer."""
    asked = filled(tool).isNotNull() & (tool != "handoff") & ~F.coalesce(rejected, F.lit(False))
    return F.when(kind == "refusal", "refusal").when(generated, "llm").when(asked, "tool").otherwise("template")


def without_credentials(result: Column) -> Column:
    """A tool's result as customers see it."""
    return F.when(F.contains(result, F.lit("token=")), text.stripped(F.regexp_replace(result, CREDENTIAL, ""))).otherwise(result)


def text_faults(title: Column, content: Column, name: Column) -> Column:
    """Which of body, title, length and name keep a text from passing; a null body has no missing name."""
    blank = lambda c: c.isNull() | (text.stripped(c) == "")
    size = F.length(F.coalesce(title, F.lit(""))) + F.length(F.coalesce(content, F.lit("")))
    faults = {"body": blank(content), "title": blank(title), "length": size > MOST_CHARS, "name": ~F.contains(content, name)}
    return F.array_compact(F.array(*[F.when(where, F.lit(fault)) for fault, where in faults.items()]))


def brand_replaced(content: Column, entity: str, label: str) -> Column:
    """The label for the entity where a whole line names it as the brand."""
    return F.regexp_replace(content, f"(?m)^品牌：{entity}$", f"品牌：{label}")


def fields_to_extract(kind: Column, schema: Column) -> Column:
    """The fields that a machine reads from an asset; schema: the product's keys, null without a product."""
    none = F.array().cast("array<string>")
    of_product = F.coalesce(F.array_remove(schema, QA_FIELD), none)
    return F.when(kind == "dialogue", F.array(F.lit(QA_FIELD))).when(kind == "image", F.array(F.lit(IMAGE_FIELD))).when(kind == "video", none).otherwise(of_product)


def ordered_fields(keys: Column, held: Column, first: Column) -> Column:
    """The keys that are held: those of `first` in its order, then the others in their own."""
    return F.array_union(F.array_intersect(F.array_intersect(first, keys), held), F.array_intersect(keys, held))


def candidate_spans(question: Column) -> Column:
    """The distinct spans of two to four characters of the runs of Chinese characters between stop characters, longer ones of a run first."""
    runs = F.split(question, f"[^一-龥]|[{text.STOP_CHARS}]")

    def of(run: Column, size: int) -> Column:
        starts = F.when(F.length(run) >= size, F.sequence(F.lit(1), F.length(run) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(run, i, F.lit(size)))

    sizes = range(LONGEST_SPAN, SHORTEST_SPAN - 1, -1)
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: F.concat(*[of(run, size) for size in sizes]))))


def asked_again(status_after: Column, answer_kind: Column) -> Column:
    """What became of a gap when its question was asked again."""
    return F.when(status_after == "resolved", "closed").when(answer_kind == "answer", "answered").otherwise("kept")


def timeline_body(items: Column) -> Column:
    """The stripped texts of the items (type, role, text) that have no role; if there are none, a line for each clip."""
    has = lambda c: c.isNotNull() & (c != "")
    spoken = F.transform(F.filter(items, lambda x: has(x["text"]) & ~has(x["role"])), lambda x: text.stripped(x["text"]))
    clips = F.transform(F.filter(items, lambda x: x["type"] == "clip"), lambda x: text.stripped(F.concat(F.lit(HIGHLIGHT), F.coalesce(x["text"], F.lit("")))))
    return F.array_join(F.when(F.size(spoken) > 0, spoken).otherwise(clips), "\n")


def spec_points(values: Column) -> Column:
    """`field：value`, masked, for each filled value of a map."""
    held = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.transform(held, lambda e: text.masked(F.concat(e["key"], F.lit("："), e["value"])))


def fallback_body(name: Column, category: Column, values: Column) -> Column:
    """A text of the product's masked head and its points, or a line that says that there are none."""
    points = spec_points(values)
    lines = F.concat(F.array(text.masked(F.concat(name, F.lit("（"), category, F.lit("）")))), F.when(F.size(points) > 0, points).otherwise(F.array(F.lit(NO_SPECS))))
    return F.array_join(lines, "\n")


def source_corrected(source: Column, title: Column, rules: list[tuple[str, str]]) -> Column:
    """The source of the first rule (pattern, source) that the title meets, for rows whose source is still `upload`."""
    fixed = source
    for pattern, kind in reversed(rules):
        fixed = F.when((source == "upload") & title.rlike(pattern), F.lit(kind)).otherwise(fixed)
    return fixed


def review_title(category: Column, review: Column) -> Column:
    return F.concat(category, F.lit("评论 · "), F.substring(text.stripped(review), 1, REVIEW_HEAD))


def dialogue_title(flow: Column, subflow: Column, question: Column) -> Column:
    """`flow/subflow · question`, without what is missing."""
    scene = F.array_join(F.array_compact(F.array(filled(flow), filled(subflow))), "/")
    head = F.substring(F.coalesce(question, F.lit("")), 1, QUESTION_HEAD)
    title = F.when(head != "", F.concat(scene, F.lit(" · "), head)).when(scene != "", scene).otherwise("ABCD 对话")
    return F.substring(title, 1, TITLE_MOST)


def evidence_sentence(kind: Column, title: Column, chunk: Column) -> Column:
    """A hit as a sentence: a dialogue's words, a document's field or its text."""
    name = F.concat(F.lit("根据已发布的规格文档《"), F.coalesce(filled(title), F.lit(NO_TITLE)), F.lit("》"))
    field = F.concat(name, F.lit("，"), F.regexp_extract(chunk, FIELD, 1), F.lit("为"), F.regexp_extract(chunk, FIELD, 2), F.lit("。"))
    plain = F.concat(name, F.lit("："), chunk, F.lit("。"))
    return F.when(kind == "dialogue", F.concat(F.lit("根据已发布的客服对话记录："), chunk)).when(chunk.rlike(FIELD), field).otherwise(plain)


def rephrased(question: Column) -> Column:
    """The question with the ending of the first rule that it meets changed."""
    out = F.concat(question, F.lit(ELSE_ENDING))
    for ending, before, after in reversed(ENDINGS):
        out = F.when(F.endswith(question, F.lit(ending)), F.concat(F.lit(before), F.regexp_replace(question, f"{ending}$", after))).otherwise(out)
    return out


def field_questions(name: Column, field: Column, value: Column) -> Column:
    """What is asked about a field: of a value with a digit whether it is that and how much, else what it is."""
    about = F.concat(name, F.lit("的"), field)
    return F.when(value.rlike("[0-9]"), F.array(F.concat(about, F.lit("是"), value, F.lit("吗")), F.concat(about, F.lit("是多少")))).otherwise(F.array(F.concat(about, F.lit("是什么"))))


def masked_fields(entries: Column, mask) -> Column:
    """A map of (value, qa) with the values and the questions and answers masked; a pair without one of them stays."""
    pair = lambda p: F.when(p["q"].isNotNull() & p["a"].isNotNull(), F.struct(mask(p["q"]).alias("q"), mask(p["a"]).alias("a"))).otherwise(p)
    return F.transform_values(entries, lambda _, e: F.struct(mask(e["value"]).alias("value"), F.transform(e["qa"], pair).alias("qa")))


def proposal(said: Column, tools: dict[str, tuple[str, str]]) -> Column:
    """What a model asks for: none, handoff, `tool:argument` or rejected.  tools: name to its one argument and the argument's pattern."""
    name, held = F.regexp_extract(said, PROPOSAL, 1), F.regexp_extract(said, PROPOSAL, 2)
    args = F.from_json(held, "map<string,string>")
    asked = F.lit("rejected")
    for tool, (key, pattern) in tools.items():
        value = F.element_at(args, key)
        fits = (F.size(args) == 1) & F.coalesce(value.rlike(f"^(?:{pattern})$"), F.lit(False))
        asked = F.when((name == tool) & fits, F.concat(F.lit(f"{tool}:"), F.upper(value))).otherwise(asked)
    plain = F.when(said.rlike(r"(?i)\bTOOL\b"), "rejected").otherwise("none")
    return F.when(F.coalesce(name, F.lit("")) == "", plain).when(F.lower(name) == "handoff", "handoff").otherwise(asked)


def picture_words(description: Column) -> Column:
    """The distinct lower-case ASCII words, and pairs of Chinese characters that have no stop character and aren't about pictures in general."""
    low = F.lower(F.coalesce(description, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[0-9a-z]+"), F.lit(0))
    pairs_of = lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    runs = F.split(low, f"[^一-鿿]|[{PICTURE_STOPS}]")  # a pair with a stop character lies in no part
    return F.array_distinct(F.concat(words, F.array_except(F.flatten(F.transform(runs, pairs_of)), F.array(*map(F.lit, PICTURE_PHRASES)))))


def description_verdict(confirmed: Column, seen: Column, failed: Column, skipped: Column) -> Column:
    """Whether two descriptions of a picture share two words, if both are there."""
    shared = F.size(F.array_intersect(picture_words(confirmed), picture_words(seen)))
    blank = lambda c: F.coalesce(text.stripped(c), F.lit("")) == ""
    return F.when(skipped, "skipped").when(failed | blank(seen), "unverified").when(blank(confirmed), "no_confirmed").when(shared >= LEAST_SHARED, "consistent").otherwise("suspect")
