"""The operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import minhash_dedup, pii, quality_rules, substring_dedup, url_filters, warc_zip
from .decontamination import op7_decontamination
from .language_id import op3_language_id
from .minhash_dedup import op2_minhash_dedup
from .pii import op5_pii
from .quality_rules import op4_quality_rules
from .sentencepiece_codec import op9_sentencepiece
from .sharding import op6_sharding
from .substring_dedup import op1_substring_dedup
from .url_filters import op8_url_filters, url_aliases_logged
from .warc_zip import op10_warc_zip

QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_minhash_dedup, op3_language_id, op4_quality_rules, op5_pii, op6_sharding, op7_decontamination, op8_url_filters, op9_sentencepiece, op10_warc_zip, url_aliases_logged)
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op5_pii": pii.ORACLE_SQL,
    "op8_url_filters": url_filters.ORACLE_SQL,
    "url_aliases_logged": url_filters.LOGGED_SQL,
    "op10_warc_zip": warc_zip.ORACLE_SQL,
}
