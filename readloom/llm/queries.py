"""The registered queries of this subpackage and their SQL."""

from readloom.llm.bpe import op2_bpe_roundtrip
from readloom.llm.embedding_dedup import op3_nn_descent
from readloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from readloom.llm.importance import OP11_SQL, op11_importance_resampling
from readloom.llm.nearest import op12_nearest_neighbours
from readloom.llm.packing import op8_best_fit_packing
from readloom.llm.quality import op10_quality
from readloom.llm.runs import op13_periodic_runs
from readloom.llm.simhash import op9_simhash
from readloom.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from readloom.llm.suffix_dedup import op7_suffix_dedup
from readloom.llm.token_files import op6_token_files
from readloom.llm.url_filter import OP4_SQL, op4_url_filter

QUERIES = {f.__name__: f for f in (op2_bpe_roundtrip, op4_url_filter, op5_exact_dedup, op6_token_files, op8_best_fit_packing, op9_simhash, op10_quality, op1_substring_dedup, op7_suffix_dedup, op3_nn_descent, op11_importance_resampling, op12_nearest_neighbours, op13_periodic_runs)}
SQL = {"op1_substring_dedup": OP1_SQL, "op4_url_filter": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op11_importance_resampling": OP11_SQL}
