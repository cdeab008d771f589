"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm.bpe import op3_bpe_codec
from quarry.llm.chat import SQL_OP7, op7_chat_format
from quarry.llm.dart_minhash import op10_near_duplicates
from quarry.llm.decontaminate import SQL_OP4, op4_decontaminate
from quarry.llm.fim import SQL_OP13, op13_fill_in_middle
from quarry.llm.langid import op6_language_id
from quarry.llm.licenses import SQL_OP12, op12_license_scan
from quarry.llm.line_dedup import SQL_OP1, op1_line_dedup
from quarry.llm.periodic import op11_periodic_runs
from quarry.llm.quality import op9_quality_rules
from quarry.llm.secrets import op8_secret_scan
from quarry.llm.token_store import op5_token_store
from quarry.llm.toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_toxicity, op3_bpe_codec, op4_decontaminate, op5_token_store, op6_language_id, op7_chat_format, op8_secret_scan, op9_quality_rules, op10_near_duplicates, op11_periodic_runs, op12_license_scan, op13_fill_in_middle)
} | {"pipeline": corpus_pipeline.run}

#: Encoders, trained models and signatures have no SQL twin; their tests hold them against brute force or held-out rows.
ORACLE_SQL = {"op1_line_dedup": SQL_OP1, "op4_decontaminate": SQL_OP4, "op7_chat_format": SQL_OP7, "op12_license_scan": SQL_OP12, "op13_fill_in_middle": SQL_OP13}
