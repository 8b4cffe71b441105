"""The corpus queries and their SQL."""

from __future__ import annotations

from vistalake.llm.decontaminate import op9_decontamination
from vistalake.llm.language_id import op6_language_id
from vistalake.llm.line_dedup import OP2_SQL, op2_line_dedup
from vistalake.llm.packing import op5_packing
from vistalake.llm.pii import op1_pii
from vistalake.llm.quality_rules import OP10_SQL, op10_quality_rules
from vistalake.llm.sharding import op4_sharding
from vistalake.llm.simhash_dedup import op8_simhash_dedup
from vistalake.llm.toxicity import op3_toxicity
from vistalake.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES = {"op2_line_dedup": OP2_SQL, "op7_warc": OP7_SQL, "op10_quality_rules": OP10_SQL}
