"""The operators' queries over their whole tables, and the same results as SQL where SQL can say it."""

from __future__ import annotations

from wardenframe.llm.bpe import op4_byte_bpe
from wardenframe.llm.divergence import OP7_SQL, op7_divergence_rules
from wardenframe.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from wardenframe.llm.html_text import op9_html_blocks
from wardenframe.llm.language import op6_language_mixture
from wardenframe.llm.lloyd import OP11_SQL, op11_dimension_sharded_lloyd
from wardenframe.llm.ngram_join import OP3_SQL, op3_ngram_jaccard
from wardenframe.llm.packing import op5_best_fit_packing
from wardenframe.llm.quality import op2_quality_classifier
from wardenframe.llm.retrieval_packing import op12_retrieval_packing
from wardenframe.llm.runs import OP13_SQL, op13_periodic_runs
from wardenframe.llm.sharding import op1_hilbert_shards
from wardenframe.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    q.__name__: q
    for q in (
        op1_hilbert_shards, op2_quality_classifier, op3_ngram_jaccard, op4_byte_bpe, op5_best_fit_packing,
        op6_language_mixture, op7_divergence_rules, op8_warc, op9_html_blocks, op10_exact_dedup,
        op11_dimension_sharded_lloyd, op12_retrieval_packing, op13_periodic_runs,
    )
}
ORACLE_SQL = {"op3_ngram_jaccard": OP3_SQL, "op7_divergence_rules": OP7_SQL, "op8_warc": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_dimension_sharded_lloyd": OP11_SQL, "op13_periodic_runs": OP13_SQL}
