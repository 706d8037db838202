"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import ann, iblt, langid, mixing, packing, pii, quality, simhash, suffixes, warc

QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        langid.op1_language_id,
        pii.op2_pii_spans,
        warc.op3_warc_derivatives,
        packing.op4_best_fit_packing,
        quality.op5_quality,
        iblt.op6_iblt_fingerprints,
        suffixes.op7_suffix_dedup,
        ann.op8_nn_descent,
        simhash.op9_simhash,
        mixing.op10_mixing,
    )
} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {k: v for k, v in {"pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
