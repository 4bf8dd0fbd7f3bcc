"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import fingerprints, phrases
from factgraph.llm.alignment import op11_pair_bitmaps
from factgraph.llm.fingerprints import op3_merkle_fingerprints
from factgraph.llm.katz import op12_katz_backoff
from factgraph.llm.minhash import op6_minhash_components
from factgraph.llm.mixing import op4_source_mix
from factgraph.llm.mpeg import op10_mpeg_media
from factgraph.llm.phrases import op13_phrase_stripes
from factgraph.llm.pii import op2_pii_anchors
from factgraph.llm.quality import op1_importance_resampling
from factgraph.llm.repeats import op5_suffix_repeats
from factgraph.llm.secrets import op7_secret_layers
from factgraph.llm.sharding import op8_feistel_shards
from factgraph.llm.tokens import op9_sentencepiece_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_pii_anchors": op2_pii_anchors,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_source_mix": op4_source_mix,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_minhash_components": op6_minhash_components,
    "op7_secret_layers": op7_secret_layers,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_sentencepiece_scan": op9_sentencepiece_scan,
    "op10_mpeg_media": op10_mpeg_media,
    "op11_pair_bitmaps": op11_pair_bitmaps,
    "op12_katz_backoff": op12_katz_backoff,
    "op13_phrase_stripes": op13_phrase_stripes,
}

ORACLES: dict[str, str] = {"op3_merkle_fingerprints": fingerprints.SQL, "op13_phrase_stripes": phrases.SQL}
