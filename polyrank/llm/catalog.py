"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from .hmm import op3_hmm
from .langid import op9_langid
from .media import op10_media
from .minhash import OP8_SQL, op8_minhash
from .mixing import OP4_SQL, op4_mixing
from .pieces import op6_pieces
from .quality import op5_quality
from .sharding import op7_sharding
from .simhash import op2_simhash
from .substrings import OP1_SQL, op1_substrings

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_simhash": op2_simhash,
    "op3_hmm": op3_hmm,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_sharding": op7_sharding,
    "op8_minhash": op8_minhash,
    "op9_langid": op9_langid,
    "op10_media": op10_media,
}
ORACLE_SQL = {"op1_substrings": OP1_SQL, "op4_mixing": OP4_SQL, "op8_minhash": OP8_SQL}
