"""Queries of this subpackage, and their SQL where SQL can express them."""

from .alignment import op13_alignment
from .conversations import OP11_SQL, op11_repair
from .fingerprints import op4_phrase_fingerprints
from .language import op2_language_id
from .licenses import op12_licenses
from .lm import OP3_SQL, op3_lm_scoring
from .mixing import op10_mixing
from .packing import op6_packing
from .sharding import op5_sharding
from .simhash import op9_simhash
from .suffix import OP8_SQL, op8_suffix_dedup
from .topk import OP7_SQL, op7_topk
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_lm_scoring, op4_phrase_fingerprints, op5_sharding, op6_packing, op7_topk, op8_suffix_dedup, op9_simhash, op10_mixing, op11_repair, op12_licenses, op13_alignment)}
ORACLES: dict[str, str] = {"op3_lm_scoring": OP3_SQL, "op7_topk": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op11_repair": OP11_SQL}
