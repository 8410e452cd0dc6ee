"""Queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from marketreach.llm import (
    chats,
    decontaminate,
    language,
    licenses,
    pieces,
    planes,
    quality,
    search,
    secrets,
    simhash,
    topk,
    trie,
    urls,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_secrets": secrets.op2_secrets,
    "op3_licenses": licenses.op3_licenses,
    "op4_language": language.op4_language,
    "op5_urls": urls.op5_urls,
    "op6_chats": chats.op6_chats,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_planes": planes.op9_planes,
    "op10_quality": quality.op10_quality,
    "op11_topk": topk.op11_topk,
    "op12_search": search.op12_search,
    "op13_trie": trie.op13_trie,
    "quality_ablations": quality.quality_ablations,
    "secrets_by_passes": secrets.secrets_by_passes,
}

SQL = {
    "op2_secrets": secrets.SQL,
    "op3_licenses": licenses.SQL,
    "op5_urls": urls.SQL,
    "op6_chats": chats.SQL,
    "op10_quality": quality.SQL,
    "op11_topk": topk.SQL,
    "op12_search": search.SQL,
    "op13_trie": trie.SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
    "secrets_by_passes": secrets.SQL,
}
