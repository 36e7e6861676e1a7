"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, bpe, language, lm, neardup, packing, pagetext, quality, repeats, runs, search, sharding, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_repeats": repeats.op2_repeats,
    "op3_quality": quality.op3_quality,
    "op4_neardup": neardup.op4_neardup,
    "op5_pagetext": pagetext.op5_pagetext,
    "op6_warc": warc.op6_warc,
    "op7_topk": search.op7_topk,
    "op8_sharding": sharding.op8_sharding,
    "op9_language": language.op9_language,
    "op10_bpe": bpe.op10_bpe,
    "op11_lm": lm.op11_lm,
    "op12_runs": runs.op12_runs,
    "op13_align": align.op13_align,
}

SQL = {
    "op3_quality": quality.SQL,
    "op4_neardup": neardup.SQL,
    "op6_warc": warc.SQL,
    "op7_topk": search.SQL,
}
