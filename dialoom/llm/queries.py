"""The operators' queries for the driver; oracle has SQL for those that SQL can express, and tests hold all to brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5_permutation_index
from .conversations import op11_conversation_repair
from .language_id import op7_language_id
from .lexical import op12_lexical_search
from .licenses import op13_license_scan
from .ngram_lm import op9_stupid_backoff
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import op8_best_fit_packing
from .pii import op10_pii
from .quality_classifier import op3_quality_classifier
from .quality_rules import op2_quality_rules
from .sentencepiece_codec import op6_sentencepiece
from .simhash import op1_simhash
from .warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_quality_rules, op3_quality_classifier, op4_warc, op5_permutation_index,
        op6_sentencepiece, op7_language_id, op8_best_fit_packing, op9_stupid_backoff, op10_pii,
        op11_conversation_repair, op12_lexical_search, op13_license_scan,
    )
}
