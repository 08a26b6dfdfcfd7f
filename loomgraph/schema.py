"""Tables of the knowledge graph and the closed sets of values in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# These literals are stored in data and must not change.
EDGE_TYPES = ("is_a", "part_of", "prerequisite_of", "related_to")
ACYCLIC_TYPES = ("prerequisite_of", "is_a", "part_of")
RELATED_KINDS = ("同题替代", "演化启发", "教学对比")
STATUSES = ("seed", "proposed", "approved", "rejected")
VISIBLE = ("seed", "approved")
NODE_TYPES = ("concept",)
MISCONCEPTION = "误区:"
DISAMBIGUATION = ("disambiguation pages", "消歧义")
TIERS = ("high", "mid", "low")
VERDICT_SUPPORT, VERDICT_OPPOSE, VERDICT_THIN = "支持", "不支持", "证据不足"
VERDICT_CONCEPT, VERDICT_FACET, DOUBTFUL = "独立概念", "应为facet", "方向存疑"
#: Limits of lengths, in characters.
MIN_PAGE, MIN_SECTION, MAX_FACET, MAX_MISCONCEPTION, MAX_ALIAS, MIN_NAME = 300, 200, 16, 40, 25, 3
MAX_PAGE = 60_000
#: Similarity of a title to be the same, and share of the longer one that a contained one must fill.
TITLE_SIMILARITY, CONTAINED_SHARE, VECTOR_SIMILARITY = 0.75, 0.6, 0.90
INFERRED_CONFIDENCE, MINED_CONFIDENCE, CATEGORY_CONFIDENCE = 0.6, 0.7, 0.5

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_STRINGS = T.ArrayType(_S)


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _table(id=_L, name=_S, type=_S, aliases=_STRINGS, definition=_S, facets=_STRINGS, status=_S, source=_S, embedding=T.ArrayType(T.FloatType()), created_at=_D)
EDGES = _table(id=_L, src=_L, dst=_L, type=_S, confidence=_D, rationale=_S, source=_S, status=_S, created_at=_D)
CORPUS = _table(id=_L, lang=_S, page_id=_L, title=_S, revision_id=_L, text=_S, redirects=_STRINGS, categories=_STRINGS, links=_STRINGS, fetched_at=_D)
NODE_PAGE = _table(node_id=_L, lang=_S, page_id=_L)
INGEST_LOG = _table(id=_L, anchor=_S, source=_S, created_at=_D)
REVIEW_LOG = _table(id=_L, item_type=_S, item_id=_L, action=_S, detail=_S, source=_S, decided_by=_S, batch_id=_S, created_at=_D)
SIGNALS = _table(link_src_dst=T.BooleanType(), link_dst_src=T.BooleanType(), refd=T.IntegerType(), toc=T.IntegerType(), wikidata=_S, has_page=T.BooleanType(), exact_title=T.BooleanType(), neighbor_overlap=T.BooleanType(), auto_would=_S)
REVIEW_SIGNALS = _table(item_type=_S, item_id=_L, signals=SIGNALS, llm_verdict=_S, llm_reason=_S, updated_at=_D)
PAGE_QID = _table(lang=_S, page_id=_L, qid=_S, fetched_at=_D)
CLAIMS = _table(qid=_S, claims=T.MapType(_S, _STRINGS), fetched_at=_D)
DOC_SECTIONS = _table(id=_L, book=_S, ord=T.IntegerType(), sec_id=_S, title=_S, url=_S, orig_lang=_S, orig_text=_S, text=_S, content_hash=_S, fetched_at=_D, translated_at=_D)
TABLES = {
    "nodes": NODES, "edges": EDGES, "corpus": CORPUS, "node_page": NODE_PAGE, "ingest_log": INGEST_LOG, "review_log": REVIEW_LOG,
    "review_signals": REVIEW_SIGNALS, "page_qid": PAGE_QID, "wikidata_claims": CLAIMS, "doc_sections": DOC_SECTIONS,
}

#: Allowed node types at both ends of each edge type.
ENDPOINTS = {t: (NODE_TYPES, NODE_TYPES) for t in EDGE_TYPES}


def visible(status: Column) -> Column:
    return status.isin(*VISIBLE)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are null, JSON text becomes arrays, maps or structs."""
    have = {f.name: f.dataType for f in df.schema}

    def column(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and isinstance(have[f.name], T.StringType)
        return (F.from_json(f.name, f.dataType.simpleString()) if nested else F.col(f.name).cast(f.dataType)).alias(f.name)

    return df.select(*[column(f) for f in schema])
