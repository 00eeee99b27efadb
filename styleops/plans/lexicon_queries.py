"""Queries over lines, styles, the lexicon, tagging and the pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleops.functions import text
from styleops.functions.draws import hash_uniform
from styleops.operators import corpus as C
from styleops.operators import lexicon as L
from styleops.operators import parallel as P
from styleops.operators import tagging as T
from styleops.plans import views as V
from styleops.plans.oracle_base import draw, query, squeeze, strip, tokens, untag, words

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = query(sql)
        return fn

    return add


def scalar(name: str, fn, sql: str) -> None:
    """A string function applied to every line of every document."""

    def run(spark, sf):
        return V.lines(spark, sf).select("row_id", fn(F.col("txt")).alias("value"))

    register(name, f"SELECT row_id, {sql} AS value FROM v_doc_lines")(run)


def joined(fn):
    return lambda x: F.array_join(fn(x), "\x1f")


def flat(sql: str) -> str:
    return f"array_to_string({sql}, chr(31))"


def grams_sql(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1]))"


SPACED = "concat_ws('', '  ', replace(txt, ',', '   '), ' ')"


def spaced(x):
    """Lines with runs of spaces inside and at both ends."""
    return F.concat(F.lit("  "), F.replace(x, F.lit(","), F.lit("   ")), F.lit(" "))


scalar("clean_sentence", lambda x: text.clean_sentence(spaced(x)), f"replace({strip(SPACED)}, chr(10), '')")
scalar("ws_tokens", joined(text.ws_tokens), flat(tokens("txt")))
scalar("space_tokens", joined(text.space_tokens), flat("string_split(txt, ' ')"))
scalar("word_tokens", joined(text.word_tokens), flat(words("txt")))
scalar(
    "ngrams_range",
    joined(lambda x: text.ngrams_range(text.word_tokens(x), 1, 2)),
    flat(grams_sql(words("txt"))),
)
scalar("squeeze_spaces", lambda x: text.squeeze_spaces(spaced(x)), squeeze(SPACED))
scalar("append_eos", text.append_eos, "txt || ' <eos>'")
scalar("wrap_target", text.wrap_target, "'<sos> ' || txt || ' <eos>'")
scalar(
    "strip_leading_quote",
    lambda x: text.strip_leading_quote(F.concat(F.lit('""'), x)),
    r"""regexp_replace('""' || txt, '\A"', '')""",
)
scalar("lowercase_option", F.lower, "lower(txt)")
scalar(
    "split_ref_list",
    lambda x: F.array_join(text.split_ref_list(F.replace(x, F.lit("."), F.lit(" ||<|>|| "))), "\x1f"),
    f"array_to_string(list_transform(string_split(replace(txt, '.', ' ||<|>|| '), '||<|>||'), lambda x: {strip('x')}), chr(31))",
)
scalar(
    "clean_meteor_hyp",
    lambda x: text.clean_meteor_hyp(F.replace(x, F.lit(","), F.lit(" ||| "))),
    "replace(replace(replace(txt, ',', ' ||| '), '|||', ''), '  ', ' ')",
)


def sql_13a(x: str) -> str:
    for old, new in text.ENTITIES_13A:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"(' ' || replace(replace({x}, '-' || chr(10), ''), chr(10), ' ') || ' ')"
    for pattern, repl in text.RULES_13A:
        x = f"regexp_replace({x}, '{pattern}', '{repl.replace('$', chr(92))}', 'g')"
    return f"array_to_string({tokens(x)}, ' ')"


scalar("tokenize_13a", text.tokenize_13a, sql_13a("txt"))


@register("filter_style", "SELECT row_id, txt, split FROM v_roles WHERE style = 'user'")
def filter_style(spark, sf):
    return C.filter_style(V.corpus_roles(spark, sf), "user").select("row_id", "txt", "split")


@register("style_counts", "SELECT style, count(*) AS n_rows FROM v_roles GROUP BY style")
def style_counts(spark, sf):
    return C.style_counts(V.corpus_roles(spark, sf))


@register("filter_split", "SELECT row_id, style, txt FROM v_corpus WHERE split = 'train'")
def filter_split(spark, sf):
    return C.filter_split(V.corpus_quality(spark, sf), "train").select("row_id", "style", "txt")


@register("lexicon_input", "SELECT row_id, style, txt FROM v_used")
def lexicon_input(spark, sf):
    return C.lexicon_input(V.corpus_quality(spark, sf)).select("row_id", "style", "txt")


@register(
    "drop_duplicate_text",
    """SELECT row_id, txt, style, split FROM v_corpus
    QUALIFY row_number() OVER (PARTITION BY txt ORDER BY row_id) = 1""",
)
def drop_duplicate_text(spark, sf):
    return C.drop_duplicate_text(V.corpus_quality(spark, sf))


@register("keep_tagged", "SELECT row_id, style, tagged FROM v_kept")
def keep_tagged(spark, sf):
    return C.keep_tagged(V.tagged(spark, sf)).select("row_id", "style", "tagged")


@register("ngram_counts", "SELECT style, term, sum(tf)::BIGINT AS freq FROM v_tf GROUP BY ALL")
def ngram_counts(spark, sf):
    return L.ngram_counts(C.lexicon_input(V.corpus_quality(spark, sf)))


def _used(spark, sf):
    return C.lexicon_input(V.corpus_quality(spark, sf))


def _tf_idf(spark, sf):
    used = _used(spark, sf)
    tf = L.term_frequencies(used)
    return used, tf, V.once("idf", spark, sf, lambda: L.doc_freq_idf(tf, used))


@register("doc_freq_idf", "SELECT style, term, freq, df, round(idf, 6) AS idf FROM v_idf")
def doc_freq_idf(spark, sf):
    used = _used(spark, sf)
    idf = L.doc_freq_idf(L.term_frequencies(used), used)
    return idf.withColumn("idf", F.round("idf", 6))


@register("tfidf_weights", "SELECT style, row_id, term, round(weight, 6) AS weight FROM v_weights")
def tfidf_weights(spark, sf):
    _, tf, idf = _tf_idf(spark, sf)
    weights = L.tfidf_weights(tf, idf)
    return weights.select("style", "row_id", "term", F.round("weight", 6).alias("weight"))


@register("mean_tfidf", "SELECT style, term, round(mean_tfidf, 9) AS mean_tfidf FROM v_means")
def mean_tfidf(spark, sf):
    used, tf, idf = _tf_idf(spark, sf)
    means = L.mean_tfidf(L.tfidf_weights(tf, idf), used)
    return means.select("style", "term", F.round("mean_tfidf", 9).alias("mean_tfidf"))


def _report(spark, sf):
    return V.once("report", spark, sf, lambda: L.class_report(L.style_stats(_used(spark, sf)), V.STYLES))


@register(
    "class_report",
    """SELECT main_style, rel_style, term, freq, round(main_mean, 9) AS main_mean,
           round(rel_mean, 9) AS rel_mean, round(main_idf, 6) AS main_idf, round(rel_idf, 6) AS rel_idf
    FROM v_report""",
)
def class_report(spark, sf):
    rounded = {"main_mean": 9, "rel_mean": 9, "main_idf": 6, "rel_idf": 6}
    return _report(spark, sf).withColumns({c: F.round(c, d) for c, d in rounded.items()})


@register(
    "relative_ratio",
    "SELECT main_style, term, round(ratio, 6) AS ratio, round(1 / ratio, 6) AS inv_ratio FROM v_ratio",
)
def relative_ratio(spark, sf):
    return L.relative_ratio(_report(spark, sf)).select(
        "main_style", "term", F.round("ratio", 6).alias("ratio"), F.round("inv_ratio", 6).alias("inv_ratio")
    )


@register("tag_probability", "SELECT main_style, term, round(prob, 9) AS prob FROM v_prob")
def tag_probability(spark, sf):
    probs = L.tag_probability(L.relative_ratio(_report(spark, sf)))
    return probs.select("main_style", "term", F.round("prob", 9).alias("prob"))


@register("pct_rank_average", "SELECT main_style, term, round(rank, 9) AS rank FROM v_ranked")
def pct_rank_average(spark, sf):
    ratios = L.relative_ratio(_report(spark, sf))
    ranked = L.pct_rank_average(ratios, "main_style", "ratio", "term")
    return ranked.select("main_style", "term", F.round("rank", 9).alias("rank"))


LEXICON_SQL = """SELECT main_style, term, freq, round(ratio, 6) AS ratio, round(prob, 9) AS prob,
    round(rank, 9) AS rank, round(score, 6) AS score FROM v_lexicon"""


def _lexicon_out(lexicon):
    digits = {"ratio": 6, "prob": 9, "rank": 9, "score": 6}
    return lexicon.withColumns({c: F.round(c, d) for c, d in digits.items()})


@register("build_lexicon", LEXICON_SQL)
def build_lexicon(spark, sf):
    return _lexicon_out(L.build_lexicon(V.corpus_quality(spark, sf), V.STYLES))


@register(
    "lexicon_select",
    "SELECT main_style, term, round(score, 6) AS score, round(prob, 9) AS prob FROM v_lexicon ORDER BY prob DESC",
)
def lexicon_select(spark, sf):
    """Listed from the most to the least probable phrase."""
    ranked = L.pct_rank_average(
        L.tag_probability(L.relative_ratio(_report(spark, sf))), "main_style", "ratio", "term"
    )
    return (
        L.lexicon_select(ranked)
        .select("main_style", "term", F.round("score", 6).alias("score"), F.round("prob", 9).alias("prob"))
        .orderBy(F.desc("prob"))
    )


@register(
    "lexicon_ignore",
    """SELECT main_style, term, round(score, 6) AS score FROM v_lexicon
    WHERE main_style <> 'q1' OR NOT list_has_any(string_split(term, ' '), ['the', 'er', 'la', 'und'])""",
)
def lexicon_ignore(spark, sf):
    kept = L.lexicon_ignore(V.lexicon(spark, sf), {"the", "er", "la", "und"}, V.STYLES[0])
    return kept.select("main_style", "term", F.round("score", 6).alias("score"))


@register(
    "hash_uniform",
    f"SELECT row_id, round({draw('row_id', '3', '1', '0')}, 9) AS u FROM v_doc_lines",
)
def hash_uniform_lines(spark, sf):
    u = hash_uniform(F.col("row_id"), 3, 1, 0)
    return V.lines(spark, sf).select("row_id", F.round(u, 9).alias("u"))


@register("phrase_candidates", "SELECT style, row_id, i, k, phrase FROM v_cand")
def phrase_candidates(spark, sf):
    return T.phrase_candidates(V.corpus_quality(spark, sf))


@register("phrase_hits", "SELECT style, row_id, i, k FROM v_hits0")
def phrase_hits(spark, sf):
    return T.phrase_hits(V.corpus_quality(spark, sf), V.lexicon(spark, sf))


@register("tag_sentences", "SELECT row_id, style, split, orig, tagged FROM v_tagged0")
def tag_sentences(spark, sf):
    return T.tag_sentences(V.corpus_quality(spark, sf), V.lexicon(spark, sf))


@register("tag_by_join", "SELECT row_id, style, split, orig, tagged FROM v_tagged0")
def tag_by_join(spark, sf):
    return T.tag_by_join(V.corpus_quality(spark, sf), V.lexicon(spark, sf))


@register(
    "tag_position",
    "SELECT row_id, i, k, least(i // 3, 20)::INT AS pos FROM v_hits0",
)
def tag_position(spark, sf):
    hits = T.phrase_hits(V.corpus_quality(spark, sf), V.lexicon(spark, sf))
    return hits.select("row_id", "i", "k", T.tag_position(F.col("i")).alias("pos"))


@register(
    "tag_stats",
    r"""SELECT split, style, count(*) AS sentences, sum(contains(tagged, style)::INT)::BIGINT AS kept,
      sum(marks)::BIGINT AS tags, round(avg(marks), 6) AS tags_per_sentence FROM (
      SELECT *, len(regexp_extract_all(tagged, '\[' || style || '[0-9]+\]')) AS marks FROM v_tagged0)
    GROUP BY split, style""",
)
def tag_stats(spark, sf):
    stats = T.tag_stats(V.tagged(spark, sf))
    return stats.withColumn("tags_per_sentence", F.round("tags_per_sentence", 6))


@register("remove_tags", f"SELECT row_id, {untag('tagged', 'style')} AS value FROM v_tagged0")
def remove_tags(spark, sf):
    return V.tagged(spark, sf).select("row_id", text.remove_tags(F.col("tagged"), F.col("style")).alias("value"))


@register("swap_tags", "SELECT row_id, replace(tagged, 'q0', 'q1') AS value FROM v_tagged0")
def swap_tags(spark, sf):
    return V.tagged(spark, sf).select("row_id", text.swap_tags(F.col("tagged"), "q0", "q1").alias("value"))


DEV = "CASE WHEN split = 'val' THEN 'dev' ELSE split END AS split"
ORD = "(style <> 'q1')::INT AS style_ord"


def pair_sql(target: str, src: str, tgt: str, both: bool) -> str:
    where = "" if both else " WHERE style = 'q1'"
    return f"""SELECT '{target}' AS target, {ORD}, row_id AS pair_id, {DEV}, {src} AS src, {tgt} AS tgt
    FROM v_kept{where}"""


TAGGER_UNI = pair_sql("tagged", squeeze(squeeze(untag("tagged", "'q1'"))), "tagged", False)
GENERATOR_UNI = pair_sql("generated", "tagged", squeeze(untag("orig", "'q0'")), False)


def _kept(spark, sf):
    return C.keep_tagged(V.tagged(spark, sf))


@register("tagger_pairs_unimodal", TAGGER_UNI)
def tagger_pairs_unimodal(spark, sf):
    return P.tagger_pairs_unimodal(_kept(spark, sf), V.STYLES)


@register("tagger_pairs_bimodal", pair_sql("tagged", squeeze("orig"), "tagged", True))
def tagger_pairs_bimodal(spark, sf):
    return P.tagger_pairs_bimodal(_kept(spark, sf), V.STYLES)


@register("generator_pairs_unimodal", GENERATOR_UNI)
def generator_pairs_unimodal(spark, sf):
    return P.generator_pairs_unimodal(_kept(spark, sf), V.STYLES)


@register("generator_pairs_bimodal", pair_sql("generated", "tagged", "orig", True))
def generator_pairs_bimodal(spark, sf):
    return P.generator_pairs_bimodal(_kept(spark, sf), V.STYLES)


@register("rename_val_dev", f"SELECT row_id, {DEV} FROM v_corpus")
def rename_val_dev(spark, sf):
    return V.corpus_quality(spark, sf).select("row_id", P.rename_val_dev(F.col("split")).alias("split"))


@register("style_parallel_corpus", f"{TAGGER_UNI} UNION ALL {GENERATOR_UNI}")
def style_parallel_corpus(spark, sf):
    return P.style_parallel_corpus(V.corpus_quality(spark, sf), V.STYLES)


@register(
    "inference_prep",
    "SELECT row_id, replace(tagged, 'q0', 'q1') || ' <eos>' AS txt FROM v_tagged0 WHERE style = 'q0'",
)
def inference_prep(spark, sf):
    lines = C.filter_style(V.tagged(spark, sf), "q0").select("row_id", F.col("tagged").alias("txt"))
    return P.inference_prep(lines, "q0", "q1")
