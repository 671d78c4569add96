"""Manifests and timelines against a plain fold over the entries."""

import random

from vergence.operators import timeline

MANIFEST = "product_id long, name string, clips array<struct<slot:string,place:int,asset_id:bigint,text:string>>, images array<struct<slot:string,place:int,asset_id:bigint,text:string>>, lines array<struct<slot:string,place:int,asset_id:bigint,text:string>>"


def said(line):
    return max(round(len("".join(line.split())) * 1000 / 4.5), 1500)


def clamp(x, low, high):
    return max(low, min(high, x))


def fold(name, clips, images, lines, template):
    """One product's entries (type, asset_id, dur, text, role), by a queue."""
    if not clips and not images and not lines:
        return None
    shots = [("clip", i, clamp(said(t), 3000, 8000)) for i, t in clips]
    pictures = [("image", i, 4000) for i, _ in images]
    queue = shots + pictures
    if template == "product_intro":
        queue = [x for pair in zip(shots + [None] * 9, pictures + [None] * 9) for x in pair if x]
    name = name.strip() or "这件好物"
    hook, cta = f"{name}，到底值不值？", f"点击主页，把{name}带回家"
    middle = []
    for _, line in lines:
        kind, at, base = queue.pop(0) if queue else ("text", None, 0)
        span = {"clip": (3000, min(8000, base)), "image": (2500, 6000), "text": (2000, 6000)}[kind]
        middle.append((kind, at, clamp(said(line), *span), line, None))
    middle += [(kind, at, base, None, None) for kind, at, base in queue]
    head = [("text", None, clamp(said(hook), 2000, 5000), hook, "hook")] if template == "product_intro" else []
    tail = clamp(said(cta), 2000, 5000)
    length = lambda: sum(x[2] for x in head + middle) + tail
    while middle and length() > 60000:
        middle.pop()
    tail += clamp(15000 - length(), 0, 4000)
    return head + middle + [("text", None, tail, cta, "cta")]


def test_timelines_against_a_queue(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("好看的杯子 ab") for _ in range(rng.randint(1, n))) + "x"
    cases = [(0, " ", [], [], [])]
    for i in range(1, 120):
        part = lambda most, n, base: [(base + j, text(n)) for j in range(rng.randint(0, most))]
        cases.append((i, rng.choice(["", "杯子", "很长的名字" * 5]), part(6, 60, 100), part(3, 5, 200), part(4, 40, 300)))
    cases.append((500, "满", [(j, "长" * 60) for j in range(6)], [(j, "") for j in range(3)], [(j, "句" * 50) for j in range(2)]))
    rows = [(i, name, *([("s", 1, a, t) for a, t in part] for part in (c, m, li))) for i, name, c, m, li in cases]
    for template in timeline.QUOTAS:
        got = {r["product_id"]: r for r in timeline.timelines(spark.createDataFrame(rows, MANIFEST), template).collect()}
        for i, name, clips, images, lines in cases:
            want, found = fold(name, clips, images, lines, template), got[i]
            if want is None:
                assert found["entries"] is None and found["duration"] is None and found["note"] is None
                continue
            assert [(e["type"], e["asset_id"], e["dur"], e["text"], e["role"]) for e in found["entries"]] == want
            assert [e["start"] for e in found["entries"]] == [sum(w[2] for w in want[:k]) for k in range(len(want))]
            assert found["duration"] == sum(w[2] for w in want) <= 60000
            assert ("不足 15s" in (found["note"] or "")) == (found["duration"] < 15000)
        assert ("裁掉了 1 段图" in (got[500]["note"] or "")) == (template == "highlight")


def test_manifest_takes_live_and_playable_assets(spark):
    products = spark.createDataFrame([(1, "杯子", ["耐热", ""]), (2, "空", None)], "product_id long, name string, points array<string>")
    plain = [(i, 1, kind, "published", None) for i, kind in enumerate(["video", "video", "video", "image", "material", "material", "video", "document", "video"])]
    assets = spark.createDataFrame([(*a, a[0] * 10) for a in plain] + [(20, 1, "image", "draft", None, 200), (21, 1, "image", "published", "2024", 210), (22, None, "image", "published", None, 220)], "asset_id long, product_id long, kind string, status string, discarded_at string, current_version_id long")
    said_of = {0: "讲别的", 1: "这杯子", 2: "很耐热", 6: "旧文本杯子", 8: None}
    versions = spark.createDataFrame([(i * 10, "a.txt" if i == 6 else "a.MP4", "一\n\n 二 \n三\n四\n五" if i == 4 else "六" if i == 5 else None, {"transcript": (said_of.get(i), False)}, None) for i in [*range(9), 20, 21, 22]], "version_id long, object_key string, body string, extracted map<string,struct<value:string,abstained:boolean>>, confirmed map<string,struct<value:string>>")
    got = {r["product_id"]: r for r in timeline.manifest(products, assets, versions, "product_intro").collect()}
    ids = lambda r, c: [x["asset_id"] for x in r[c]]
    assert (ids(got[1], "clips"), ids(got[1], "images"), [x["text"] for x in got[1]["lines"]]) == ([1, 2, 0], [3], ["一", "二", "三", "四"])
    assert (got[2]["clips"], got[2]["images"], got[2]["lines"]) == ([], [], [])
    assert timeline.manifest(products.where("false"), assets, versions, "highlight").count() == 0
