"""Queries of this subpackage and the SQL of those that SQL can express."""

from stagekit.llm.ann import op1_ann
from stagekit.llm.langid import op10_langid
from stagekit.llm.lmscore import op6_lm_score
from stagekit.llm.mixing import OP7_SQL, op7_mixing
from stagekit.llm.neardup import op3_neardup
from stagekit.llm.pieces import op2_sentencepiece
from stagekit.llm.quality import op8_quality
from stagekit.llm.secret_scan import op4_secrets
from stagekit.llm.sharding import op9_sharding
from stagekit.llm.tokencount import op5_token_counts

QUERIES = {
    "op1_ann": op1_ann,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_neardup": op3_neardup,
    "op4_secrets": op4_secrets,
    "op5_token_counts": op5_token_counts,
    "op6_lm_score": op6_lm_score,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_langid": op10_langid,
}

ORACLES = {
    "op7_mixing": OP7_SQL,
}
