"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lotwise.llm import oracles
from lotwise.llm.block_anchors import op12_block_anchors
from lotwise.llm.packing import op7_packing
from lotwise.llm.piece_codec import op10_sentencepiece
from lotwise.llm.quality_model import op6_quality
from lotwise.llm.quality_rules import op8_quality_rules
from lotwise.llm.secret_scan import op3_secrets
from lotwise.llm.simhash import op2_simhash
from lotwise.llm.suffix_dedup import op5_suffix_dedup
from lotwise.llm.topk import op9_top_k
from lotwise.llm.turn_repair import op11_turn_repair
from lotwise.llm.url_filter import op4_url_filter
from lotwise.llm.warc import op1_warc
from lotwise.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_secrets, op4_url_filter, op5_suffix_dedup, op6_quality, op7_packing, op8_quality_rules, op9_top_k, op10_sentencepiece, op11_turn_repair, op12_block_anchors, op13_whitening)}
#: The others (fingerprints by XXH64, marginal bytes, a classifier, vocabularies, eigenvectors) have brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_warc": oracles.OP1, "op4_url_filter": oracles.OP4, "op5_suffix_dedup": oracles.OP5, "op8_quality_rules": oracles.OP8, "op9_top_k": oracles.OP9, "op11_turn_repair": oracles.OP11, "op12_block_anchors": oracles.OP12}
