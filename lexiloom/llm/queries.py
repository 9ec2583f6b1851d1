"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from . import bpe, decontam, langid, licenses, neardup, quality, secret_scan, sharding, topk, toxicity

QUERIES = {
    "op1_exact_topk": topk.query,
    "op4_hilbert_sharding": sharding.query,
    "op3_byte_bpe": bpe.query,
    "op8_secret_scan": secret_scan.query,
    "op2_language_id": langid.query,
    "op6_toxicity": toxicity.query,
    "op9_minhash_dedup": neardup.query,
    "op7_quality": quality.query,
    "op10_license_scan": licenses.query,
    "op5_decontamination": decontam.query,
}
SQL: dict[str, str] = {"op1_exact_topk": topk.SQL, "op4_hilbert_sharding": sharding.SQL, "op5_decontamination": decontam.SQL, "op8_secret_scan": secret_scan.SQL, "op9_minhash_dedup": neardup.SQL}
