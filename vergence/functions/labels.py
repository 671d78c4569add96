"""Classifiers of questions by fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each intent, as patterns.
LISTING = "卖什么|卖啥|有什么|有啥|都卖哪|卖哪些|有哪些|目录|在售"
PRICE = "多少钱|价格|售价|定价|报价|收费|贵不贵|便宜|花多少|怎么卖|怎么买|卖多少|什么价|啥价|多钱|咋卖|咋买|咋样卖|咋样买|咋价|贵"
POLICY = "退货|退换|退了|退款|运费|邮费|物流|快递|优惠|折扣|发票|收据|税费|保价|赔偿"
SPEC = "净含量|保质期|材质|品牌|存储容量|内存|屏幕尺寸|容量|作者|图片|官网|高度|宽度|上市年份|规格|参数|毫升|毫安|保修|刻度|批号|型号|尺码|成分|配料|产地|重量|体积|颜色|包装|口味|度数|尺寸"
TRIVIAL = "你们|咱们|本店|小店|店铺|店里|店|铺|请问|一下|当前|现在|目前|商品|东西|产品|宝贝|出售|在卖|卖|有|哪些|什么|列表|清单|全|部|都|和|与|[的吗呢啊嘛呀吧呗哦噢]|、|，|？|\\?|！|!|。| |　"
RETURN, RETURN_PROGRESS, RETURN_POLICY = "退货|退换|退了", "进度|轨迹|物流|事件|到哪|状态|查询", "政策|条件|流程|支持|规则|怎么退|如何退|可以退吗|能退吗"
SCOPE = ("有没有([^，。！？?！\\s]{1,12})", "你们(?:卖|有)([^，。！？?]{1,12})吗", "有([^，。！？?]{1,12})吗", "卖不卖([^，。！？?]{1,12})")
GENERIC_SCOPE = ("货", "现货", "库存", "赠品", "优惠", "折扣", "活动", "发票", "保修", "问题", "颜色", "款")
SCOPE_MODIFIERS = "别的|其他|其它|这个|那个|新的|一款|另一个"
META_QUESTION = "^我.*(?:问题|上一个)"
ALIASES = {
    "笔记本": "笔记本电脑", "笔电": "笔记本电脑", "手提电脑": "笔记本电脑", "电脑": "笔记本电脑", "本本": "笔记本电脑", "手机": "智能手机", "智能机": "智能手机", "平板": "平板电脑", "电视": "电视机",
    "彩电": "电视机", "零食": "食品", "吃的": "食品", "食物": "食品", "书": "图书", "书籍": "图书", "书本": "图书", "杯子": "器皿", "水杯": "器皿",
}


def catalog_intent(question: Column, human: str = "人工|真人|转客服") -> Column:
    """listing, price or null: a wish for a human and words of policy come first, then a pure listing, then prices."""
    rest = F.regexp_replace(F.regexp_replace(question, f"^(.*?)(?:{LISTING})", "$1"), TRIVIAL, "")
    return (
        F.when(question.rlike(human) | question.rlike(POLICY), F.lit(None))
        .when(question.rlike(LISTING), F.when(rest == "", "listing"))
        .when(question.rlike(PRICE), "price")
        .when(question.rlike("多少") & ~question.rlike(SPEC), "price")
    )


def wants_return(question: Column) -> Column:
    return question.rlike(RETURN) & ~question.rlike(RETURN_PROGRESS) & ~question.rlike(RETURN_POLICY)


def scope_entity(question: Column) -> Column:
    """What a question of the kind `do you have X` asks for; null for others."""
    found = [F.regexp_extract(question, p, 1) for p in SCOPE]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def scope_kind(question: Column, known: Column) -> Column:
    """not_scope, generic, in_scope (the question names a known product) or out_of_scope."""
    core = F.regexp_replace(scope_entity(question), f"^(?:{SCOPE_MODIFIERS})", "")
    return F.when(scope_entity(question).isNull(), "not_scope").when(core.isin(*GENERIC_SCOPE) | core.rlike("多久|几天|几次"), "generic").when(known, "in_scope").otherwise("out_of_scope")


def category_target(question: Column, categories: list[str]) -> Column:
    """The category that a question names: by an alias in the table's order, then by name, the longest first."""
    targets = [(a, c) for a, c in ALIASES.items() if c in categories] + [(c, c) for c in sorted(set(categories), key=len, reverse=True)]
    return F.coalesce(*[F.when(F.contains(question, F.lit(a)), c) for a, c in targets], F.lit(None).cast("string"))


def without_secrets(line: Column) -> Column:
    """Query tokens and passwords of addresses are starred out."""
    tokens = F.regexp_replace(line, r"(?i)([?&](?:token|access_token|key)=)[^&\s]+", "$1***")
    return F.regexp_replace(tokens, r"(://[^:/@\s]+:)[^@/\s]+@", "$1***@")
