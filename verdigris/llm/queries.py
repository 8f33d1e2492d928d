"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from verdigris.llm.bpe import op10_bpe
from verdigris.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from verdigris.llm.language import op3_language_id
from verdigris.llm.licenses import op1_license_scan
from verdigris.llm.mixing import OP2_SQL, op2_source_mixing
from verdigris.llm.quality import op4_quality_rules
from verdigris.llm.secrets import op9_secret_scan
from verdigris.llm.sharding import OP8_SQL, op8_sharding
from verdigris.llm.simhash_dedup import op7_simhash_near_dedup
from verdigris.llm.wavelet import op6_token_output


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_source_mixing": op2_source_mixing,
        "op3_language_id": op3_language_id,
        "op4_quality_rules": op4_quality_rules,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_token_output": op6_token_output,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_sharding": op8_sharding,
        "op9_secret_scan": op9_secret_scan,
        "op10_bpe": op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_source_mixing": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op8_sharding": OP8_SQL}
    return sql if corpus_pipeline.ORACLE_SQL is None else sql | {"pipeline": corpus_pipeline.ORACLE_SQL}
