"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from veriref.llm import bpe, chat, langid, minhash, mixing, pii, quality, simhash, toxicity, warc

QUERIES: dict[str, Callable] = {
    "op1_quality_outliers": quality.op1_quality_outliers,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_merkle_fixity": warc.op3_merkle_fixity,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_minhash_fingerprints": minhash.op5_minhash_fingerprints,
    "op6_language_id": langid.op6_language_id,
    "op7_pii": pii.op7_pii,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES: dict[str, str] = {"op2_source_mixing": mixing.ORACLE, "op3_merkle_fixity": warc.ORACLE}
