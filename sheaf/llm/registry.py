"""The queries of the training-data operators, and the SQL that checks them."""

from sheaf.llm import bytepairs, collocations, jaccard, lines, merkle, mixing, packing, pii, search, suffixes, toxicity, urls, vectors

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_suffix_dedup": suffixes.query,
    "op3_embedding_dedup": vectors.query,
    "op4_url_filter": urls.query,
    "op5_topk": search.query,
    "op6_pii": pii.query,
    "op7_mix_sources": mixing.query,
    "op8_jaccard_join": jaccard.query,
    "op9_packing": packing.query,
    "op10_toxicity": toxicity.query,
    "op11_collocations": collocations.query,
    "op12_merkle_manifest": merkle.query,
    "op13_byte_pairs": bytepairs.query,
}

#: Where SQL can express the whole result on whole tables; the others are tested by brute force.
ORACLES = {
    "op1_line_dedup": lines.SQL,
    "op5_topk": search.SQL,
    "op7_mix_sources": mixing.SQL,
    "op11_collocations": collocations.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
