"""Column expressions for tiers, channels, signals and review labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def source_tier(source: Column, book_tiers: Mapping[str, str] | None = None) -> Column:
    """Quality tier of a source string; books are high unless their configuration says otherwise, unknown sources low."""
    s = F.coalesce(source, F.lit(""))
    book = F.split_part(s, F.lit(":"), F.lit(2))
    told = {b: t for b, t in (book_tiers or {}).items() if t in S.TIERS}
    tier = F.coalesce(F.create_map(*[F.lit(x) for kv in told.items() for x in kv])[book], F.lit("high")) if told else F.lit("high")
    return (
        F.when(s.startswith("seed"), "high").when(s.startswith("doc:"), tier)
        .when(s.startswith("wiki:") | s.startswith("mine:") | s.startswith("wikidata"), "mid").otherwise("low")
    )


def auto_adjudicable(source: Column, book_tiers: Mapping[str, str] | None = None) -> Column:
    return source_tier(source, book_tiers) != "low"


def channel(source: Column) -> Column:
    """Channel label of calibration reports: mined sources keep two parts."""
    s = F.coalesce(source, F.lit(""))
    return (
        F.when(s.startswith("doc:"), F.concat(F.lit("doc:"), F.split_part(s, F.lit(":"), F.lit(2)))).when(s.startswith("wiki:"), "ingest/expand")
        .when(s.startswith("mine:"), F.substring_index(s, ":", 2)).when(s.startswith("wikidata"), "wikidata").when(s.startswith("seed"), "seed")
        .when(s == "", "(空)").otherwise(s)
    )


def log_channel(source: Column) -> Column:
    """Channel label of log statistics: mined sources stay whole, seeds too."""
    return (
        F.when(source.startswith("mine:"), source).when(source.startswith("wikidata"), "wikidata")
        .when(source.startswith("doc:"), F.concat(F.lit("doc:"), F.split_part(source, F.lit(":"), F.lit(2)))).when(source.startswith("wiki:"), "ingest/expand").otherwise(source)
    )


def verdict_key(verdict: Column) -> Column:
    """A verdict without its target; any doubt in parentheses becomes one mark."""
    v = F.split_part(F.coalesce(verdict, F.lit("")), F.lit("→"), F.lit(1))
    return F.when(F.contains(v, F.lit("(")), F.concat(F.split_part(v, F.lit("("), F.lit(1)), F.lit("(方向?)"))).otherwise(v)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _sign(c: Column) -> Column:
    return F.coalesce(F.signum(c), F.lit(0.0))


def supported(signals: Column) -> Column:
    """Whether any structural signal backs an edge."""
    told = F.coalesce(signals["wikidata"], F.lit("")) != ""
    return _true(told | _true(signals["link_src_dst"]) | _true(signals["link_dst_src"]) | (_sign(signals["toc"]) > 0))


def opposed(edge_type: Column, signals: Column) -> Column:
    """Whether a directional signal speaks against a prerequisite."""
    return _true((edge_type == "prerequisite_of") & ((_sign(signals["refd"]) < 0) | (_sign(signals["toc"]) < 0)))


def reference_direction(link_src_dst: Column, link_dst_src: Column) -> Column:
    """+1 if only the target's page links to the source, -1 if only the other way round, else 0."""
    return link_dst_src.cast("int") - link_src_dst.cast("int")


def bucket(item_type: Column, signals: Column, verdict: Column) -> Column:
    """Label of the combination of signals."""
    both, one = _true(signals["link_src_dst"]) & _true(signals["link_dst_src"]), _true(signals["link_src_dst"]) | _true(signals["link_dst_src"])
    arrow = lambda name: F.when(_sign(signals[name]) > 0, f"{name}↑").when(_sign(signals[name]) < 0, f"{name}↓")
    edge = F.concat_ws("+", F.when(both, "互链").when(one, "单向链"), arrow("refd"), arrow("toc"), F.when(F.coalesce(signals["wikidata"], F.lit("")) != "", "wikidata"))
    node = F.concat_ws("+", F.when(_true(signals["has_page"]), "有页"), F.when(_true(signals["exact_title"]), "精确命中"))
    v = verdict_key(verdict)
    label = F.concat_ws("+", F.nullif(F.when(item_type == "edge", edge).otherwise(node), F.lit("")), F.when(v != "", F.concat(F.lit("LLM:"), v)))
    return F.when(label == "", "无信号").otherwise(label)


def triage(item_type: Column, edge_type: Column, signals: Column, verdict: Column) -> Column:
    """struct(tier, label): 0 conflict, 1 thin or unreviewed, 2 weak agreement."""
    answer = lambda tier, label: F.struct(F.lit(tier).alias("tier"), (F.lit(label) if isinstance(label, str) else label).alias("label"))
    v = F.coalesce(verdict, F.lit(""))
    exact = _true(signals["has_page"]) & _true(signals["exact_title"])
    node = (
        F.when(v.startswith(S.VERDICT_FACET), answer(0, v))
        .when((v == S.VERDICT_CONCEPT) & exact & ~F.coalesce(signals["neighbor_overlap"], F.lit(True)), answer(0, "名字命中语料页但页面与图谱邻居无重叠（疑似撞名）"))
        .when((v == S.VERDICT_CONCEPT) & exact, answer(2, "信号弱一致"))
        .when(v == S.VERDICT_CONCEPT, answer(0, "LLM 判独立概念但名字未命中语料页"))
        .otherwise(answer(1, "证据不足"))
    )
    conflict = F.contains(v, F.lit(S.DOUBTFUL)) | (v.startswith(S.VERDICT_SUPPORT) & opposed(edge_type, signals)) | (v.startswith(S.VERDICT_OPPOSE) & supported(signals))
    edge = F.when(conflict, answer(0, "信号冲突")).when(v.startswith(S.VERDICT_THIN), answer(1, "证据不足")).otherwise(answer(2, "信号弱一致"))
    return F.when(v == "", answer(1, "未复核")).when(item_type == "node", node).otherwise(edge)


def signal_line(item_type: Column, signals: Column, verdict: Column, reason: Column) -> Column:
    """One readable line of all signals of an item."""
    a, b = _true(signals["link_src_dst"]), _true(signals["link_dst_src"])
    links = F.when(signals["link_src_dst"].isNotNull(), F.concat(F.lit("语料链接: "), F.when(a & b, "互链").when(a, "仅 src→dst").when(b, "仅 dst→src").otherwise("无互链")))
    way = lambda name, label: F.when(_sign(signals[name]) != 0, F.concat(F.lit(label), F.when(_sign(signals[name]) > 0, "支持").otherwise("方向可疑")))
    told = F.when(F.coalesce(signals["wikidata"], F.lit("")) != "", F.concat(F.lit("Wikidata: "), signals["wikidata"]))
    edge = F.concat_ws("；", links, way("refd", "RefD 先修信号: "), way("toc", "教材目录序: "), told)
    overlap = F.when(signals["neighbor_overlap"], "（与图谱邻居有重叠）").when(~signals["neighbor_overlap"], "（与图谱邻居无重叠，疑似撞名）").otherwise("")
    page = F.concat(F.lit("有语料页"), F.when(_true(signals["exact_title"]), "（名字精确命中标题/重定向）").otherwise(""), overlap)
    node = F.when(signals["has_page"].isNotNull(), F.when(signals["has_page"], page).otherwise("无语料页"))
    review = F.when(F.coalesce(verdict, F.lit("")) != "", F.concat(F.lit("LLM 复核: "), verdict, F.lit("（"), F.coalesce(reason, F.lit("")), F.lit("）")))
    return F.concat_ws("；", F.nullif(F.when(item_type == "edge", edge).otherwise(node), F.lit("")), review)


def edge_verdict(verdict: Column, direction_ok: Column) -> Column:
    """An edge verdict with a mark where the reviewer doubts the direction."""
    v = F.coalesce(verdict, F.lit(S.VERDICT_THIN))
    return F.when(F.coalesce(direction_ok, F.lit(True)), v).otherwise(F.concat(v, F.lit(f"({S.DOUBTFUL})")))


def node_verdict(verdict: Column, facet_of: Column) -> Column:
    v, of = F.coalesce(verdict, F.lit(S.VERDICT_THIN)), F.coalesce(facet_of, F.lit(""))
    return F.when((v == S.VERDICT_FACET) & (of != ""), F.concat(v, F.lit("→"), of)).otherwise(v)


def merged_signals(old: Column, new: Column) -> Column:
    """Field by field, the new value where there is one."""
    return F.struct(*[F.coalesce(new[f.name], old[f.name]).alias(f.name) for f in S.SIGNALS])
