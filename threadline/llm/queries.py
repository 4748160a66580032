"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from threadline.llm import op1_embeddings as op1
from threadline.llm import op7_topk as op7
from threadline.llm import op10_ngram_join as op10
from threadline.llm import op13_divergence as op13
from threadline.llm.op11_alignment import op11_alignment
from threadline.llm.op12_license import op12_license
from threadline.llm.op2_pii import op2_pii
from threadline.llm.op3_html import op3_html
from threadline.llm.op4_suffix import op4_suffix
from threadline.llm.op5_sentencepiece import op5_sentencepiece
from threadline.llm.op6_quality import op6_quality
from threadline.llm.op8_packing import op8_packing
from threadline.llm.op9_toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1.op1_embeddings, op2_pii, op3_html, op4_suffix, op5_sentencepiece, op6_quality, op7.op7_topk,
                                    op8_packing, op9_toxicity, op10.op10_ngram_join,
                                    op11_alignment, op12_license, op13.op13_divergence)}

ORACLE: dict[str, str] = {"op1_embeddings": op1.SQL, "op7_topk": op7.SQL,
                          "op10_ngram_join": op10.SQL, "op13_divergence": op13.SQL}
