"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from corpusloom.llm.filter_audit import op13_filter_audit
from corpusloom.llm.mixing import op2_mixing
from corpusloom.llm.neighbours import op1_nn_descent
from corpusloom.llm.ngram_join import op9_ngram_jaccard
from corpusloom.llm.packing import op10_best_fit_packing
from corpusloom.llm.quality_knn import op6_quality_classifier
from corpusloom.llm.quality_rules import op3_quality_rules
from corpusloom.llm.secrets import op4_secret_scan
from corpusloom.llm.sharding import op12_sharding
from corpusloom.llm.sql import SQL
from corpusloom.llm.token_counts import op5_token_counts
from corpusloom.llm.url_filter import op8_url_filter
from corpusloom.llm.warc import op7_warc
from corpusloom.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_mixing, op3_quality_rules, op4_secret_scan, op5_token_counts, op6_quality_classifier, op7_warc, op8_url_filter, op9_ngram_jaccard, op10_best_fit_packing, op11_whitening, op12_sharding, op13_filter_audit)}
__all__ = ["QUERIES", "SQL"]
