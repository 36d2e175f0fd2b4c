"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillspan.llm import license_scan, line_dedup, manifest, warc
from quillspan.llm.ann import op9_nearest_vectors
from quillspan.llm.bpe import op3_bpe_round_trip
from quillspan.llm.jaccard_join import op5_ngram_jaccard_join
from quillspan.llm.license_scan import op7_license_scan
from quillspan.llm.line_dedup import op11_line_dedup
from quillspan.llm.manifest import op13_merkle_manifest
from quillspan.llm.mixing import op10_mix_sources
from quillspan.llm.quality_classifier import op2_quality_classifier
from quillspan.llm.quality_rules import op1_quality_rules
from quillspan.llm.substring_dedup import op6_substring_dedup
from quillspan.llm.token_files import op8_token_files
from quillspan.llm.warc import op4_warc_bundles
from quillspan.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_warc_bundles": op4_warc_bundles,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_token_files": op8_token_files,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_mix_sources": op10_mix_sources,
    "op11_line_dedup": op11_line_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_bundles": warc.ORACLE_SQL,
    "op7_license_scan": license_scan.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op13_merkle_manifest": manifest.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
