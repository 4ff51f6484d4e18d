"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tradewire.llm import decontam, langid, lattice, linededup, packing, secrets, setjoin, sharding, suffixdup, vectordup

QUERIES = {
    "op1_lattice_likelihood": lattice.op1,
    "op2_secret_scan": secrets.op2,
    "op3_packing": packing.op3,
    "op4_ngram_jaccard_join": setjoin.op4,
    "op5_line_dedup": linededup.op5,
    "op6_extendible_sharding": sharding.op6,
    "op7_embedding_near_dedup": vectordup.op7,
    "op8_benchmark_decontamination": decontam.op8,
    "op9_suffix_dedup": suffixdup.op9,
    "op10_language_id": langid.op10,
}

ORACLES: dict[str, str] = {
    "op6_extendible_sharding": sharding.ORACLE,
}
