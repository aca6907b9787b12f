"""The registered queries of this package, and SQL where SQL can express them."""
from .chat import OP7_SQL, op7_chat
from .html_text import op9_html_text
from .lexical import OP11_SQL, op11_lexical_search
from .media import op5_media
from .mixing import OP8_SQL, op8_mixing
from .negatives import OP12_SQL, op12_hard_negatives
from .ngram_join import OP1_SQL, op1_ngram_join
from .packing import op10_packing
from .pii import op3_pii
from .quality_model import op6_quality_model
from .quality_rules import OP2_SQL, op2_quality_rules
from .token_counts import op13_token_counts
from .token_store import op4_token_store

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_token_store": op4_token_store,
    "op5_media": op5_media,
    "op6_quality_model": op6_quality_model,
    "op7_chat": op7_chat,
    "op8_mixing": op8_mixing,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}
ORACLE = {
    "op1_ngram_join": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op7_chat": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
