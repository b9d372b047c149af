"""The dealt operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, embeddup, langid, neardup, nndescent, packing, partcodes, pitmanyor, records, resampling, sharding, suffixes, urlrank

QUERIES = {
    "op1_sparse_suffixes": suffixes.op1_sparse_suffixes,
    "op2_histogram_sort": sharding.op2_histogram_sort,
    "op3_token_records": records.op3_token_records,
    "op4_chosen_path": neardup.op4_chosen_path,
    "op5_cross_parsing": langid.op5_cross_parsing,
    "op6_templates": decontaminate.op6_templates,
    "op7_link_graph": urlrank.op7_link_graph,
    "op8_pitman_yor": pitmanyor.op8_pitman_yor,
    "op9_nn_descent": nndescent.op9_nn_descent,
    "op10_concatenate_and_cut": packing.op10_concatenate_and_cut,
    "op11_int8_tiles": embeddup.op11_int8_tiles,
    "op12_bit_sliced": resampling.op12_bit_sliced,
    "op13_anchors_codes": partcodes.op13_anchors_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_sparse_suffixes": suffixes.SQL,
    "op4_chosen_path": neardup.SQL,
    "op7_link_graph": urlrank.SQL,
    "op11_int8_tiles": embeddup.SQL,
    "op12_bit_sliced": resampling.SQL,
    "op13_anchors_codes": partcodes.SQL,
}
