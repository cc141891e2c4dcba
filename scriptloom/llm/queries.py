"""The registered queries of this subpackage and their DuckDB oracles."""

from scriptloom.llm import bpe, exact_dedup, fingerprints, languages, licenses, minhash, packing, resharding, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_minmax_near_dedup": minhash.op2_minmax_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_min_cost_resharding": resharding.op4_min_cost_resharding,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_bpe_chunk_reuse": bpe.op7_bpe_chunk_reuse,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_language_id": languages.op9_language_id,
    "op10_bottom_k_fingerprints": fingerprints.op10_bottom_k_fingerprints,
}

ORACLES = {"op1_warc": warc.OP1_SQL, "op2_minmax_near_dedup": minhash.OP2_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL}
