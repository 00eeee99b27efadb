"""Source/target pairs for the tagger and the generator from kept tagged sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.functions import text
from styleops.operators.corpus import keep_tagged
from styleops.operators.lexicon import build_lexicon
from styleops.operators.tagging import tag_sentences
from styleops.session import checkpointed


def rename_val_dev(split: Column) -> Column:
    return F.when(split == "val", F.lit("dev")).otherwise(split)


def _pairs(kept: DataFrame, styles: tuple[str, ...], target: str, src: Column, tgt: Column) -> DataFrame:
    """The first style's rows come before the second's, as ``style_ord`` tells the sink."""
    order = F.array_position(F.array(*[F.lit(s) for s in styles]), F.col("style")).cast("int") - 1
    return kept.filter(F.col("style").isin(*styles)).select(
        F.lit(target).alias("target"),
        order.alias("style_ord"),
        F.col("row_id").alias("pair_id"),
        rename_val_dev(F.col("split")).alias("split"),
        src.alias("src"),
        tgt.alias("tgt"),
    )


def tagger_pairs_unimodal(kept: DataFrame, styles: tuple[str, str]) -> DataFrame:
    bare = text.squeeze_spaces(text.squeeze_spaces(text.remove_tags(F.col("tagged"), styles[0])))
    return _pairs(kept, styles[:1], "tagged", bare, F.col("tagged"))


def tagger_pairs_bimodal(kept: DataFrame, styles: tuple[str, str]) -> DataFrame:
    return _pairs(kept, styles, "tagged", text.squeeze_spaces(F.col("orig")), F.col("tagged"))


def generator_pairs_unimodal(kept: DataFrame, styles: tuple[str, str]) -> DataFrame:
    plain = text.squeeze_spaces(text.remove_tags(F.col("orig"), styles[1]))
    return _pairs(kept, styles[:1], "generated", F.col("tagged"), plain)


def generator_pairs_bimodal(kept: DataFrame, styles: tuple[str, str]) -> DataFrame:
    return _pairs(kept, styles, "generated", F.col("tagged"), F.col("orig"))


def pairs_of(kept: DataFrame, styles: tuple[str, str], unimodal: bool) -> DataFrame:
    if unimodal:
        return tagger_pairs_unimodal(kept, styles).unionByName(generator_pairs_unimodal(kept, styles))
    return tagger_pairs_bimodal(kept, styles).unionByName(generator_pairs_bimodal(kept, styles))


def style_parallel_corpus(
    corpus: DataFrame,
    styles: tuple[str, str],
    unimodal: bool = True,
    ngram_range: tuple[int, int] = (1, 2),
    thresh: float = 0.90,
    lexicon: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """From a labelled corpus to the training pairs of both models.

    Pass ``lexicon`` (for example read back from a file) to skip mining it. The tagged rows are
    written once, since both kinds of pairs are made of them.
    """
    both = corpus.filter(F.col("style").isin(*styles))
    if lexicon is None:
        lexicon = build_lexicon(both, styles, ngram_range, thresh=thresh)
    kept = checkpointed(keep_tagged(tag_sentences(both, lexicon, seed)))
    return pairs_of(kept, styles, unimodal)


def inference_prep(
    lines: DataFrame, source_label: str, target_label: str, segment=None
) -> DataFrame:
    """Tagger output to generator input: swap the label, segment, append the end mark."""
    swapped = text.swap_tags(text.rstrip(F.col("txt")), source_label, target_label)
    out = swapped if segment is None else segment(swapped)
    return lines.withColumn("txt", text.append_eos(out))
