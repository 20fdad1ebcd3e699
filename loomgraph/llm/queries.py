"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

import corpus_pipeline
from loomgraph.llm import divergence
from loomgraph.llm.alignment import op12_token_alignment
from loomgraph.llm.decontaminate import op7_decontamination
from loomgraph.llm.divergence import op11_source_divergence
from loomgraph.llm.lengths import op1_token_counts
from loomgraph.llm.line_dedup import op3_line_dedup
from loomgraph.llm.lm_scoring import op10_lm_scoring
from loomgraph.llm.mixing import op13_source_mixing
from loomgraph.llm.ngram_join import op4_ngram_jaccard_join
from loomgraph.llm.packing import op6_best_fit_packing
from loomgraph.llm.quality import op8_quality_rules
from loomgraph.llm.substrings import op9_substring_dedup
from loomgraph.llm.toxicity import op2_toxicity
from loomgraph.llm.warc import op5_warc

QUERIES = {q.__name__: q for q in (op1_token_counts, op2_toxicity, op3_line_dedup, op4_ngram_jaccard_join, op5_warc, op6_best_fit_packing, op7_decontamination, op8_quality_rules, op9_substring_dedup, op10_lm_scoring, op11_source_divergence, op12_token_alignment, op13_source_mixing)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = {"op11_source_divergence": divergence.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
