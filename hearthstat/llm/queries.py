"""The registered queries of this subpackage and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from hearthstat.llm.decontaminate import OP3_SQL, op3_decontamination
from hearthstat.llm.licenses import op13_license_scan
from hearthstat.llm.merkle import OP11_SQL, op11_merkle_manifest
from hearthstat.llm.near_dedup import op4_near_dedup
from hearthstat.llm.neighbours import op7_neighbours
from hearthstat.llm.pieces import op5_pieces
from hearthstat.llm.pii import op8_personal_data
from hearthstat.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from hearthstat.llm.secrets import op9_secret_scan
from hearthstat.llm.sharding import op10_kd_sharding
from hearthstat.llm.substrings import op2_substring_dedup
from hearthstat.llm.token_files import op1_token_files
from hearthstat.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_pieces": op5_pieces,
    "op6_toxicity": op6_toxicity,
    "op7_neighbours": op7_neighbours,
    "op8_personal_data": op8_personal_data,
    "op9_secret_scan": op9_secret_scan,
    "op10_kd_sharding": op10_kd_sharding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
