"""The queries of this subpackage, by name; the SQL of those that SQL can express."""

from __future__ import annotations

from corpus_pipeline import run as pipeline
from tidemark.llm.decontaminate import op1
from tidemark.llm.hard_negatives import op11
from tidemark.llm.lexical import op12
from tidemark.llm.license_scan import op4
from tidemark.llm.neighbours import op9
from tidemark.llm.oracles import ORACLE_SQL  # noqa: F401
from tidemark.llm.packing import op3
from tidemark.llm.secret_scan import op5
from tidemark.llm.sharding import op2
from tidemark.llm.simhash import op7
from tidemark.llm.suffix_dedup import op6
from tidemark.llm.token_output import op8
from tidemark.llm.toxicity import op10
from tidemark.llm.warc import op13

QUERIES = {
    "pipeline": pipeline,
    "op1_decontaminate": op1,
    "op2_shard": op2,
    "op3_pack": op3,
    "op4_licenses": op4,
    "op5_secrets": op5,
    "op6_repeats": op6,
    "op7_simhash": op7,
    "op8_training_order": op8,
    "op9_neighbours": op9,
    "op10_toxicity": op10,
    "op11_hard_negatives": op11,
    "op12_search": op12,
    "op13_warc": op13,
}
