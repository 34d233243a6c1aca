"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .collocations import op13_collocations
from .conversations import op12_conversations
from .decontamination import OP5_SQL, op5_decontamination
from .licenses import op9_licenses
from .quality import OP8_SQL, op8_quality_rules
from .sentencepieces import op3_sentencepiece
from .sharding import op6_shards
from .simhash import op7_simhash
from .suffixes import op11_suffixes
from .token_counts import op10_token_counts
from .token_files import op1_token_files
from .toxicity import op2_toxicity
from .warc_zip import OP4_SQL, op4_warc

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_shards": op6_shards,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_licenses": op9_licenses,
    "op10_token_counts": op10_token_counts,
    "op11_suffixes": op11_suffixes,
    "op12_conversations": op12_conversations,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op8_quality_rules": OP8_SQL,
}
