"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS; prints one JSON line.

Tables several queries start from (lexicon, tagged text, pairs, vocabulary, ids) are written before
the clock starts; ``style_parallel_corpus`` and ``build_lexicon`` do all their work on the clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

from styleops.plans import registry
from styleops.plans import views as V
from styleops.session import local_session

HEADLINE = [
    "style_parallel_corpus",
    "build_lexicon",
    "tag_sentences",
    "ngram_counts",
    "tokenize_13a",
    "build_vocab",
    "encode_ids",
    "pack_batches",
    "noise_pipeline",
    "length_buckets",
    "bleu_corpus",
    "rouge_l",
    "cider",
    "meteor_exact",
    "greedy_matching",
    "nbest_topk",
    "nearest_sentences",
    "bpe_encode",
    "stream_tag",
    "stream_prepare",
    "nearest_words",
    "compute_metrics",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    V.table(spark, sf, "documents").write.format("noop").mode("overwrite").save()
    for prepare in (V.eval_pairs, V.encoded, V.word_vectors):
        prepare(spark, sf)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
