"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .kneser_ney import op2_kneser_ney
from .ngram_join import OP6_SQL, op6_ngram_join
from .packing import op9_best_fit_packing
from .pii import PII_BASE_SQL, op1_pii, pii_base_spans
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op4_quality_classifier
from .secrets import op3_secret_scan
from .syncmers import EDITED_SQL, op10_closed_syncmers, syncmer_edited_texts
from .url_filter import OP12_SQL, op12_url_filter
from .warc import OP7_SQL, op7_warc_index

QUERIES = {
    "op1_pii": op1_pii,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc_index": op7_warc_index,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_closed_syncmers": op10_closed_syncmers,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_url_filter": op12_url_filter,
    "op13_prefix_trie": op13_prefix_trie,
    "pii_base_spans": pii_base_spans,
    "syncmer_edited_texts": syncmer_edited_texts,
}

ORACLES: dict[str, str] = {
    "pii_base_spans": PII_BASE_SQL,
    "syncmer_edited_texts": EDITED_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_ngram_join": OP6_SQL,
    "op7_warc_index": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_url_filter": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
