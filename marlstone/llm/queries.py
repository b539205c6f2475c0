"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from marlstone.llm.collocations import SQL as OP13_SQL
from marlstone.llm.collocations import op13_collocations
from marlstone.llm.decontamination import op4_decontamination
from marlstone.llm.divergence import SQL as OP12_SQL
from marlstone.llm.divergence import op12_source_divergence
from marlstone.llm.language_id import op9_language_id
from marlstone.llm.minhash import op11_fingerprints
from marlstone.llm.packing import op6_packing
from marlstone.llm.pseudonyms import op5_pii
from marlstone.llm.quality_knn import op3_quality_classifier
from marlstone.llm.quality_rules import op10_quality_rules
from marlstone.llm.sharding import op7_sharding
from marlstone.llm.simhash import op8_simhash
from marlstone.llm.suffix_dedup import op1_suffix_dedup
from marlstone.llm.token_counts import op2_token_counts

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op7_sharding": op7_sharding,
    "op11_fingerprints": op11_fingerprints,
    "op12_source_divergence": op12_source_divergence,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op12_source_divergence": OP12_SQL, "op13_collocations": OP13_SQL}
