"""The registered query of each operator, and the SQL of those that SQL can express."""

from ledgerlane.llm import (
    collocations,
    decontamination,
    fingerprints,
    hamming,
    jaccard,
    language,
    packing,
    pii,
    quality,
    resharding,
    search,
    toxicity,
    urls,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_language": language.op7_language,
    "op8_urls": urls.op8_urls,
    "op9_resharding": resharding.op9_resharding,
    "op10_minhash": fingerprints.op10_minhash,
    "op11_hamming": hamming.op11_hamming,
    "op12_search": search.op12_search,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {**jaccard.SQL, **hamming.SQL, **search.SQL, **collocations.SQL}
