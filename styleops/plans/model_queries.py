"""Queries over vocabulary, batches, noise, hypotheses, vectors, subwords, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleops.functions import noise as NZ
from styleops.functions import text
from styleops.operators import batching as BA
from styleops.operators import bpe as BP
from styleops.operators import language_model as LM
from styleops.operators import corpus as C
from styleops.operators import nbest as NB
from styleops.operators import parallel as P
from styleops.operators import scale
from styleops.operators import tagging as T
from styleops.operators import vectors as VE
from styleops.operators import vocab as VO
from styleops.plans import views as V
from styleops.plans.lexicon_queries import pair_sql
from styleops.plans.oracle_base import draw, query, rstrip, squeeze, tokens, untag, view
from styleops.session import scratch_path, written
from styleops.sources import files as S
from styleops.streaming import lines as ST

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = query(sql)
        return fn

    return add


def ids_text(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


# ---- vocabulary and encoding

view(
    "v_tp",
    f"""SELECT row_id AS pair_id, (style <> 'q1')::INT AS style_ord,
      CASE WHEN split = 'val' THEN 'dev' ELSE split END AS split, {squeeze('orig')} AS src, tagged AS tgt FROM v_kept""",
)
view(
    "v_vlines",
    """SELECT 0 AS file_no, style_ord, pair_id, src AS txt FROM v_tp WHERE split = 'train'
    UNION ALL SELECT 1, style_ord, pair_id, tgt FROM v_tp WHERE split = 'train'""",
)
view("v_vt", f"SELECT file_no, style_ord, pair_id, {tokens('txt')} AS t FROM v_vlines")
view(
    "v_vtok",
    """SELECT token, count(*) AS cnt, min((file_no, style_ord, pair_id, i)) AS seen FROM (
      SELECT file_no, style_ord, pair_id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM v_vt)
    GROUP BY token""",
)
view(
    "v_specials",
    "SELECT * FROM (VALUES (0, '<pad>'), (1, '<sos>'), (2, '<eos>'), (3, '<unk>'), (4, '[GMASK]')) s(id, token)",
)
view(
    "v_vocab",
    """SELECT id, token, 0 AS cnt FROM v_specials UNION ALL
    SELECT (4 + row_number() OVER (ORDER BY cnt DESC, seen DESC))::INT, token, cnt FROM v_vtok
    WHERE cnt >= 2 AND token NOT IN (SELECT token FROM v_specials)""",
)
view(
    "v_srct",
    f"SELECT pair_id, {tokens('src')} || ['<eos>'] AS t FROM v_tp",
)
view("v_tgtt", f"SELECT pair_id, ['<sos>'] || {tokens('tgt')} || ['<eos>'] AS t FROM v_tp")


def cells_sql(source: str) -> str:
    return f"""SELECT pair_id, i, coalesce(id, 3) AS id, token FROM (
      SELECT pair_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token FROM {source})
    LEFT JOIN v_vocab USING (token)"""


view("v_src", cells_sql("v_srct"))
view("v_tgt", cells_sql("v_tgtt"))


def ids_sql(cells: str, name: str) -> str:
    return f"SELECT pair_id, string_agg(id::VARCHAR, ' ' ORDER BY i) AS {name} FROM {cells} GROUP BY pair_id"


@register("build_vocab", "SELECT id, token, cnt FROM v_vocab")
def build_vocab(spark, sf):
    return VO.build_vocab(V.vocab_lines(spark, sf), ["file_no", "style_ord", "pair_id"])


@register(
    "encode_ids",
    f"""SELECT pair_id, src_ids, tgt_ids FROM ({ids_sql('v_src', 'src_ids')})
    JOIN ({ids_sql('v_tgt', 'tgt_ids')}) USING (pair_id)""",
)
def encode_ids(spark, sf):
    enc = VO.encode_pairs(V.pairs(spark, sf), V.vocab(spark, sf))
    return enc.select("pair_id", ids_text("src_ids").alias("src_ids"), ids_text("tgt_ids").alias("tgt_ids"))


@register(
    "decode_ids",
    """SELECT pair_id, coalesce(string_agg(token, ' ' ORDER BY i) FILTER (id NOT IN (1, 2)), '') AS txt FROM (
      SELECT pair_id, i, t.id, v.token FROM v_tgt t JOIN v_vocab v ON v.id = t.id) GROUP BY pair_id""",
)
def decode_ids(spark, sf):
    return VO.decode_ids(V.encoded(spark, sf), "pair_id", "tgt_ids", V.vocab(spark, sf))


@register(
    "oov_rate",
    """SELECT split, count(*) AS tokens, sum((id = 3)::INT)::BIGINT AS unknown,
      round(avg((id = 3)::INT), 6) AS oov_rate FROM v_src JOIN v_tp USING (pair_id) GROUP BY split""",
)
def oov_rate(spark, sf):
    splits = V.pairs(spark, sf).select("pair_id", "split")
    rates = VO.oov_rate(V.encoded(spark, sf).join(splits, "pair_id"), "src_ids", "split")
    return rates.withColumn("oov_rate", F.round("oov_rate", 6))


@register(
    "word_freq",
    "SELECT token AS word, count(*) AS freq FROM (SELECT unnest(t) AS token FROM v_vt) GROUP BY token",
)
def word_freq(spark, sf):
    return VO.word_freq(V.vocab_lines(spark, sf))


@register(
    "align_vectors",
    """SELECT v.id, v.token, round(list_sum(coalesce(x.vec, [0.0])), 6) AS total,
      round(coalesce(x.vec[1], 0), 6) AS first FROM v_vocab v LEFT JOIN (
        SELECT coalesce(v.id, 3) AS id, arg_max(w.vec, w.id) AS vec FROM v_vectors w
        LEFT JOIN v_vocab v ON v.token = w.word GROUP BY 1) x ON x.id = v.id""",
)
def align_vectors(spark, sf):
    vectors = V.word_vectors(spark, sf).select(F.col("id").alias("line_no"), "word", "vec")
    aligned = VO.align_vectors(V.vocab(spark, sf), vectors, 64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return aligned.select(
        "id", "token", F.round(total, 6).alias("total"), F.round(F.get("vec", F.lit(0)), 6).alias("first")
    )


view("v_tlp", "SELECT token, ln(count(*) / sum(count(*)) OVER ()) AS log_p FROM v_tgt GROUP BY token")


@register(
    "perplexity",
    """SELECT count(*) AS tokens, round(exp(-avg(log_p)), 6) AS perplexity FROM v_tgt JOIN v_tlp USING (token)
    WHERE token NOT IN ('<pad>', '<sos>')""",
)
def perplexity(spark, sf):
    return VO.perplexity(V.token_log_probs(spark, sf)).withColumn("perplexity", F.round("perplexity", 6))


view("v_bigram", "SELECT split, id AS v, lead(id) OVER (PARTITION BY pair_id ORDER BY i) AS w FROM v_tgt JOIN v_tp USING (pair_id)")
view("v_seen", "SELECT v, w, count(*) AS n FROM v_bigram WHERE split = 'train' AND w IS NOT NULL GROUP BY v, w")
view("v_context", "SELECT v, sum(n) AS total, count(*) AS kinds FROM v_seen GROUP BY v")
view(
    "v_share",
    f"""SELECT id AS w, {1 - LM.EVEN} * coalesce(contexts, 0) / (SELECT count(*) FROM v_seen) + {LM.EVEN} / (SELECT count(*) FROM v_vocab) AS share
    FROM v_vocab LEFT JOIN (SELECT w AS id, count(*) AS contexts FROM v_seen GROUP BY w) USING (id)""",
)


@register(
    "perplexity_bigram",
    f"""SELECT split, count(*) AS tokens, round(exp(-avg(ln(CASE WHEN total IS NULL THEN share
      ELSE greatest(coalesce(n, 0) - {LM.DISCOUNT}, 0) / total + {LM.DISCOUNT} * kinds / total * share END))), 6) AS perplexity
    FROM v_bigram LEFT JOIN v_seen USING (v, w) LEFT JOIN v_context USING (v) JOIN v_share USING (w) WHERE w IS NOT NULL GROUP BY split""",
)
def perplexity_bigram(spark, sf):
    """Targets of each split under a model of the training targets."""
    targets = V.encoded(spark, sf).join(V.pairs(spark, sf).select("pair_id", "split"), "pair_id")
    # counted once, for the model as well as for its use
    counts = written(LM.bigram_counts(targets, "tgt_ids", ["split"]))
    model = LM.BigramModel.of_counts(counts.filter("split = 'train'"), V.vocab(spark, sf).count())
    return model.perplexity_of_counts(counts, ["split"]).withColumn("perplexity", F.round("perplexity", 6))


# ---- batches

@register(
    "length_buckets",
    """SELECT row_id, n, (row_number() OVER (PARTITION BY n ORDER BY row_id) - 1)
      % (count(*) OVER (PARTITION BY n) // 128 + 1) AS batch FROM v_toks""",
)
def length_buckets(spark, sf):
    rows = C.clean(V.corpus_quality(spark, sf)).select("row_id", F.size(text.ws_tokens(F.col("txt"))).alias("n"))
    return BA.length_buckets(rows, "row_id", "n")


view(
    "v_samples",
    """SELECT pair_id, a, b, row_number() OVER (ORDER BY pair_id) AS s
    FROM (SELECT pair_id, len(t) AS a FROM v_srct) JOIN (SELECT pair_id, len(t) AS b FROM v_tgtt) USING (pair_id)""",
)
view(
    "v_fit",
    """SELECT s, t, (max(a) OVER w + max(b) OVER w) * (t - s + 1) <= 8000 AS ok FROM (
      SELECT x.s, y.s AS t, y.a, y.b FROM (SELECT s, unnest(range(128)) AS d FROM v_samples) x JOIN v_samples y ON y.s = x.s + x.d)
    WINDOW w AS (PARTITION BY s ORDER BY t)""",
)
view(
    "v_next",
    """SELECT s, greatest(coalesce(min(t) FILTER (WHERE NOT ok), max(t) + 1), s + 1) AS e, bool_or(t = s AND ok) AS fits
    FROM v_fit GROUP BY s""",
)
view(
    "v_chain",
    "SELECT 1::BIGINT AS s, 0::BIGINT AS bat UNION ALL SELECT n.e, c.bat + n.fits::INT FROM v_chain c JOIN v_next n ON n.s = c.s",
)
view(
    "v_packed",
    """SELECT CASE WHEN fits THEN bat ELSE -1 END AS batch_no, (CASE WHEN fits THEN x.s - n.s ELSE -1 END)::INT AS pos, pair_id
    FROM v_chain c JOIN v_next n ON n.s = c.s JOIN v_samples x ON x.s >= n.s AND x.s < n.e""",
)


def _lengths(spark, sf):
    return V.encoded(spark, sf).select(
        "pair_id", F.size("src_ids").alias("src_len"), F.size("tgt_ids").alias("tgt_len")
    )


def _packed(spark, sf):
    return V.once("packed", spark, sf, lambda: BA.pack_batches(_lengths(spark, sf)))


@register("pack_batches", "SELECT batch_no, pos, pair_id FROM v_packed")
def pack_batches(spark, sf):
    return BA.pack_batches(_lengths(spark, sf))


@register(
    "shuffle_samples",
    f"""SELECT pair_id, row_number() OVER (ORDER BY {draw('pair_id', "'order'", '0')}, pair_id) - 1 AS at FROM v_tp""",
)
def shuffle_samples(spark, sf):
    return BA.shuffle_samples(V.pairs(spark, sf).select("pair_id"), "pair_id")


view(
    "v_batch",
    """SELECT batch_no, pos, pair_id, len(t) AS length, max(len(t)) OVER (PARTITION BY batch_no) AS longest,
    ids FROM v_packed JOIN v_srct USING (pair_id)
    JOIN (SELECT pair_id, list(id ORDER BY i) AS ids FROM v_src GROUP BY pair_id) USING (pair_id) WHERE batch_no >= 0""",
)


def _padded(spark, sf):
    rows = _packed(spark, sf).filter("batch_no >= 0").join(
        V.encoded(spark, sf).select("pair_id", "src_ids"), "pair_id"
    )
    return BA.pad_batch(rows, "src_ids")


@register(
    "pad_batch",
    """SELECT pair_id, batch_no, length, array_to_string(list_concat(ids, list_transform(range(longest - length),
      lambda x: 0))::VARCHAR[], ' ') AS src_ids FROM v_batch""",
)
def pad_batch(spark, sf):
    return _padded(spark, sf).select("pair_id", "batch_no", "length", ids_text("src_ids").alias("src_ids"))


@register(
    "pad_mask",
    """SELECT pair_id, array_to_string(list_transform(range(longest), lambda i: (i > length)::INT)::VARCHAR[], '') AS mask,
      array_to_string(list_transform(range(longest), lambda i: (i >= length)::INT)::VARCHAR[], '') AS mask_strict
    FROM v_batch""",
)
def pad_mask(spark, sf):
    def bits(strict):
        mask = BA.pad_mask(F.col("src_ids"), F.col("length"), strict)
        return F.array_join(F.transform(mask, lambda b: b.cast("int").cast("string")), "")

    return _padded(spark, sf).select("pair_id", bits(True).alias("mask"), bits(False).alias("mask_strict"))


@register(
    "drop_consecutive_duplicates",
    f"""SELECT pair_id, tgt_ids FROM (
      SELECT pair_id, pos, tgt_ids, lag(tgt_ids) OVER (PARTITION BY batch_no ORDER BY pos) AS before
      FROM v_packed JOIN ({ids_sql("v_tgt", "tgt_ids")}) USING (pair_id) WHERE batch_no >= 0)
    WHERE before IS NULL OR tgt_ids <> before""",
)
def drop_consecutive_duplicates(spark, sf):
    targets = V.encoded(spark, sf).select("pair_id", "tgt_ids")
    rows = _packed(spark, sf).filter("batch_no >= 0").join(targets, "pair_id")
    kept = C.drop_consecutive_duplicates(rows, "tgt_ids", BA.BATCH, "pos")
    return kept.select("pair_id", ids_text("tgt_ids").alias("tgt_ids"))


@register(
    "mask_tokens",
    f"""SELECT pair_id, string_agg((CASE WHEN {draw('pair_id', 'i', '0')} < score THEN 4 ELSE c.id END)::VARCHAR, ' '
      ORDER BY i) AS tgt_ids FROM v_tgt c JOIN v_tp p USING (pair_id)
      LEFT JOIN (SELECT (main_style <> 'q1')::INT AS style_ord, v.id, score FROM v_lexicon l
        JOIN v_vocab v ON v.token = l.term) m ON m.id = c.id AND m.style_ord = p.style_ord GROUP BY pair_id""",
)
def mask_tokens(spark, sf):
    """Each target is masked by the phrases of its own style."""
    style = (F.col("main_style") != V.STYLES[0]).cast("int").alias("style_ord")
    phrases = V.lexicon(spark, sf).select(style, F.col("term").alias("token"), "score")

    def scored():
        return phrases.join(V.vocab(spark, sf), "token").select("style_ord", "id", "score", "cnt")

    styles = V.pairs(spark, sf).select("pair_id", "style_ord")
    targets = V.encoded(spark, sf).join(styles, "pair_id")
    masked = T.mask_tokens(targets, "tgt_ids", V.once("mask_scores", spark, sf, scored), by=["style_ord"])
    return masked.select("pair_id", ids_text("tgt_ids").alias("tgt_ids"))


# ---- noise, as relations of cells (pair_id, i, id)

VOCAB_SIZE = "(SELECT count(*) FROM v_vocab)"
HIT = "CASE WHEN id = 1 THEN 0 WHEN id IN (0, 2) THEN {k} + 1 ELSE {free} END"


def u(tag: str) -> str:
    return draw("pair_id", "i", f"'{tag}'", "0")


def sql_drop(src: str, p: float) -> str:
    return f"""SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY dropped, i) - 1 AS i,
      CASE WHEN dropped = 1 THEN 0 ELSE id END AS id FROM (
      SELECT *, CASE WHEN i = 0 OR {u('drop')} > {p} THEN 0 ELSE 1 END AS dropped FROM {src})"""


def sql_blank(src: str, p: float) -> str:
    return f"SELECT pair_id, i, CASE WHEN {u('blank')} < {p} AND id NOT IN (0, 1, 2) THEN 3 ELSE id END AS id FROM {src}"


def sql_substitute(src: str, p: float) -> str:
    return f"""SELECT pair_id, i, CASE WHEN {u('substitute')} > {p} OR id IN (0, 1, 2, 4) THEN id
      ELSE floor({u('new')} * {VOCAB_SIZE})::INT END AS id FROM {src}"""


def sql_shuffle(src: str, k: int) -> str:
    shift = HIT.format(k=k, free=f"{k + 1} * {u('shuffle')}")
    return f"SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY i + {shift}, i) - 1 AS i, id FROM {src}"


def sql_insert(src: str, hit: str, what: str) -> str:
    return f"""SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY o) - 1 AS i, id FROM (
      SELECT pair_id, i * 2 AS o, id FROM {src} UNION ALL
      SELECT pair_id, i * 2 + 1, {what} FROM (SELECT *, max(i) OVER (PARTITION BY pair_id) AS last FROM {src})
        WHERE i < last AND {hit} UNION ALL
      SELECT pair_id, max(i) * 2 + 2, 0 FROM {src} GROUP BY pair_id)"""


def sql_tags(src: str, p: float) -> str:
    return sql_insert(src, f"{u('tag')} < {p}", "3")


def sql_markers(src: str, p: float) -> str:
    return sql_insert(src, f"id = 3 AND {u('marker')} < {p}", "3")


def sql_marker_shuffle(src: str, k: int) -> str:
    reach = k // 2 - 1
    shift = HIT.format(k=k, free=f"CASE WHEN near = 1 THEN {k + 1} * {u('marker_shuffle')} ELSE 0 END")
    return f"""SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY i + {shift}, i) - 1 AS i, id FROM (
      SELECT *, max((id = 3)::INT) OVER (PARTITION BY pair_id ORDER BY i
        ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS near FROM {src})"""


def _noise(name: str, sql: str, fn) -> None:
    view(f"v_noise_{name}", sql)

    @register(name, ids_sql(f"v_noise_{name}", "ids"))
    def run(spark, sf):
        size = V.once("vocab_size", spark, sf, lambda: V.vocab(spark, sf).agg(F.count(F.lit(1)).alias("n")))
        n = size.first()["n"]
        noisy = fn(F.col("src_ids"), F.col("pair_id"), n)
        return V.encoded(spark, sf).select("pair_id", ids_text(noisy).alias("ids"))


_noise("word_shuffle", sql_shuffle("v_src", 2), lambda x, key, n: NZ.word_shuffle(x, key, 2))
_noise("word_drop", sql_drop("v_src", 0.1), lambda x, key, n: NZ.word_drop(x, key, 0.1))
_noise("word_blank", sql_blank("v_src", 0.1), lambda x, key, n: NZ.word_blank(x, key, 0.1))
_noise("word_substitute", sql_substitute("v_src", 0.075), lambda x, key, n: NZ.word_substitute(x, key, 0.075, n))
_noise("insert_tags", sql_tags("v_src", 0.1), lambda x, key, n: NZ.insert_tags(x, key, 0.1))
_noise("duplicate_markers", sql_markers("v_src", 0.5), lambda x, key, n: NZ.duplicate_markers(x, key, 0.5))
_noise("marker_shuffle", sql_marker_shuffle("v_src", 6), lambda x, key, n: NZ.marker_shuffle(x, key, 6))

view("v_n1", sql_drop("v_src", 0.025))
view("v_n2", sql_blank("v_n1", 0.05))
view("v_n3", sql_substitute("v_n2", 0.075))
view("v_n4", sql_markers("v_n3", 0.1))
view("v_n5", sql_marker_shuffle("v_n4", 3))
view("v_n6", sql_tags("v_n5", 0.1))


def full_noise(ids, key, n):
    return NZ.noise_pipeline(ids, key, n, 0.025, 0.05, 0.075, 2, 0.1, 1.0)


_noise("noise_pipeline", sql_shuffle("v_n6", 2), full_noise)


# ---- hypotheses

view(
    "v_hyp",
    f"""SELECT sent_id, hyp_id, ['<sos>'] || {tokens('txt')} || ['<eos>'] AS tokens,
      ln(1 - {draw('sent_id', 'hyp_id', "'beam'")}) AS log_p FROM (
      SELECT row_id AS sent_id, unnest([0, 1, 2, 3]) AS hyp_id,
        unnest([tagged, orig, {untag('tagged', 'style')}, tagged || ' ' || tagged]) AS txt FROM v_tagged0)""",
)
view(
    "v_top",
    """SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, hyp_id DESC) AS place FROM (
      SELECT *, log_p / pow(len(tokens), 0.5) AS score FROM v_hyp) QUALIFY place <= 3""",
)


@register("nbest_topk", "SELECT sent_id, hyp_id, round(score, 6) AS score, place FROM v_top")
def nbest_topk(spark, sf):
    top = NB.nbest_topk(V.hypotheses(spark, sf), 3, 0.5)
    return top.select("sent_id", "hyp_id", F.round("score", 6).alias("score"), "place")


@register(
    "nbest_prefer_tag",
    """SELECT sent_id, hyp_id, round(score, 6) AS score, n_tags FROM (
      SELECT *, len(list_filter(tokens, lambda t: contains(t, '[q1'))) AS n_tags FROM v_top)
    QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY n_tags DESC, score DESC, hyp_id DESC) = 1""",
)
def nbest_prefer_tag(spark, sf):
    best = NB.nbest_prefer_tag(V.hypotheses(spark, sf), "[q1", 3, 0.5)
    return best.select("sent_id", "hyp_id", F.round("score", 6).alias("score"), "n_tags")


@register(
    "truncate_output",
    """SELECT sent_id, hyp_id, array_to_string(tokens[2 : least(coalesce(list_position(tokens, '<eos>') - 1, len(tokens)), 201)], ' ')
      AS txt FROM v_hyp""",
)
def truncate_output(spark, sf):
    out = NB.truncate_output(F.col("tokens"))
    return V.hypotheses(spark, sf).select("sent_id", "hyp_id", F.array_join(out, " ").alias("txt"))


# ---- vectors


@register(
    "l2_normalize",
    """SELECT vec_id, d, round(x / norm, 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d,
      unnest(embedding)::DOUBLE AS x, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS norm
      FROM embeddings)""",
)
def l2_normalize(spark, sf):
    unit = VE.l2_normalize(F.col("embedding"))
    rows = V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("d", "x"))
    return rows.withColumn("x", F.round("x", 6))


view(
    "v_centroid",
    """SELECT label, list(x ORDER BY d) AS vec FROM (SELECT label, d, avg(x) AS x FROM (
      SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)
      GROUP BY label, d) GROUP BY label""",
)


@register(
    "nearest_sentences",
    """SELECT c.label AS query, vec_id AS id,
      round(list_inner_product(embedding::DOUBLE[], vec) / sqrt(list_inner_product(vec, vec)), 6) AS score,
      row_number() OVER (PARTITION BY c.label ORDER BY
        round(list_inner_product(embedding::DOUBLE[], vec) / sqrt(list_inner_product(vec, vec)), 9) DESC, vec_id) AS place
    FROM embeddings, v_centroid c QUALIFY place <= 5""",
)
def nearest_sentences(spark, sf):
    """Five rows nearest to the mean vector of each label."""
    rows = V.table(spark, sf, "embeddings")
    means = (
        rows.select("label", F.posexplode("embedding").alias("d", "x"))
        .groupBy("label", "d")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("cells"))
        .select(F.col("label").cast("long").alias("id"), F.col("cells.x").alias("vec"))
    )
    found = VE.nearest_sentences(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), means)
    return found.select("query", "id", F.round("score", 6).alias("score"), "place")


@register(
    "nearest_words",
    """SELECT a.word, b.word AS near, round(list_cosine_similarity(a.vec, b.vec), 6) AS score, row_number() OVER (
      PARTITION BY a.word ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id) AS place
    FROM v_vectors a, v_vectors b QUALIFY place <= 10""",
)
def nearest_words(spark, sf):
    vectors = V.word_vectors(spark, sf)
    found = VE.nearest_words(vectors.select("id", "word", "vec"), vectors.select("word"))
    return found.withColumn("score", F.round("score", 6))


# ---- subwords

SUBWORDS = 16_000


def _merges(spark, sf):
    def make():
        return BP.merges_frame(spark, BP.bpe_train(VO.word_freq(V.vocab_lines(spark, sf)), vocab_size=SUBWORDS))

    rows = V.once("merges", spark, sf, make).orderBy("rank").collect()
    return [(r["a"], r["b"]) for r in rows]


@register("bpe_train")
def bpe_train(spark, sf):
    return BP.merges_frame(spark, BP.bpe_train(VO.word_freq(V.vocab_lines(spark, sf)), vocab_size=SUBWORDS))


@register("bpe_encode")
def bpe_encode(spark, sf):
    encode = BP.encoder(_merges(spark, sf))
    return V.lines(spark, sf).select("row_id", encode("txt").alias("pieces"))


@register("bpe_decode", f"SELECT row_id, array_to_string({tokens('txt')}, ' ') AS txt FROM v_doc_lines")
def bpe_decode(spark, sf):
    """Every line cut into pieces and joined again."""
    encode = BP.encoder(_merges(spark, sf))
    return V.lines(spark, sf).select("row_id", BP.bpe_decode(encode("txt")).alias("txt"))


@register("inference_segmented")
def inference_segmented(spark, sf):
    """Both steps of inference that need no model: originals cut into pieces for the tagger, tagged lines for the generator."""
    encode = BP.encoder(_merges(spark, sf))
    lines = C.filter_style(V.tagged(spark, sf), "q0")
    opening = lines.select("row_id", F.lit("tagger").alias("step"), text.append_eos(encode(text.rstrip(F.col("orig")))).alias("txt"))
    tagged = lines.select("row_id", F.lit("generator").alias("step"), F.col("tagged").alias("txt"))
    return opening.unionByName(P.inference_prep(tagged, "q0", "q1", encode))


# ---- files: written to a scratch folder, then read back


@register(
    "read_lexicon",
    "SELECT main_style, term, round(score, 6) AS score FROM v_lexicon",
)
def read_lexicon(spark, sf):
    path = scratch_path(spark, "lexicon")
    S.write_lexicon(V.lexicon(spark, sf), path)
    return S.read_lexicon(spark, path).withColumn("score", F.round("score", 6))


@register("write_split_files", "SELECT row_id, orig, tagged, split, style FROM v_kept")
def write_split_files(spark, sf):
    path = scratch_path(spark, "split")
    S.write_split_files(C.keep_tagged(V.tagged(spark, sf)), path)
    return spark.read.parquet(path)


@register(
    "write_parallel",
    f"""SELECT 'tagged' AS target, split, style_ord, pair_id, src, tgt FROM v_tp
    UNION ALL SELECT target, split, style_ord, pair_id, src, tgt FROM ({pair_sql("generated", "tagged", "orig", True)})""",
)
def write_parallel(spark, sf):
    path = scratch_path(spark, "parallel")
    S.write_parallel(P.pairs_of(C.keep_tagged(V.tagged(spark, sf)), V.STYLES, False), path)
    return spark.read.parquet(path)


@register(
    "write_aligned",
    f"""SELECT row_number() OVER (ORDER BY style_ord, pair_id) - 1 AS line_no, {rstrip('src')} AS src,
      {rstrip('tgt')} AS tgt FROM v_tp""",
)
def write_aligned(spark, sf):
    """Pairs written as two line-aligned text folders and joined again by line number."""
    path = scratch_path(spark, "aligned")
    S.write_aligned(V.pairs(spark, sf), [F.col("style_ord"), F.col("pair_id")], ["src", "tgt"], path)
    return S.read_pairs(*[S.read_lines(spark, f"{path}/{side}") for side in ("src", "tgt")])


def _numbered(spark, sf):
    lines = V.pairs(spark, sf).select("style_ord", "pair_id", "src", "tgt")
    return V.once(
        "numbered", spark, sf, lambda: scale.ordered_index(lines, [F.col("style_ord"), F.col("pair_id")], "line_no")
    )


@register(
    "read_pairs",
    "SELECT row_number() OVER (ORDER BY style_ord, pair_id) - 1 AS line_no, src, tgt FROM v_tp",
)
def read_pairs(spark, sf):
    rows = _numbered(spark, sf)
    return S.read_pairs(
        rows.select("line_no", F.col("src").alias("txt")), rows.select("line_no", F.col("tgt").alias("txt"))
    )


@register(
    "read_refs",
    """SELECT pair_id, array_to_string([a.txt, b.txt], chr(31)) AS refs FROM
      (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pair_id, txt FROM v_doc_lines) a
      JOIN (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pair_id, txt FROM v_roles) b USING (pair_id)""",
)
def read_refs(spark, sf):
    """Two files of different length: the result is as long as the shorter one."""
    files = [
        scale.ordered_index(df.select("row_id", "txt"), [F.col("row_id")], "line_no")
        for df in (V.lines(spark, sf), V.corpus_roles(spark, sf))
    ]
    return S.read_refs(files).select("pair_id", F.array_join("refs", "\x1f").alias("refs"))


def _text_file(df, spark, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


@register("read_lines", f"SELECT txt, count(*) AS n FROM (SELECT regexp_replace(txt, '\\s+\\z', '') AS txt FROM v_doc_lines) GROUP BY txt")
def read_lines(spark, sf):
    """Lines written as text and read back; numbers are dense, so they are summed up as a check."""
    path = _text_file(V.lines(spark, sf).select("txt"), spark, "lines")
    return S.read_lines(spark, path).groupBy("txt").agg(F.count(F.lit(1)).alias("n"))


@register("read_lines_numbers", "SELECT count(*) AS n, 0 AS low, count(*) - 1 AS high, count(*) AS different FROM v_doc_lines")
def read_lines_numbers(spark, sf):
    path = _text_file(V.lines(spark, sf).select("txt"), spark, "lines")
    no = F.col("line_no")
    return S.read_lines(spark, path).agg(
        F.count(no).alias("n"), F.min(no).alias("low"), F.max(no).alias("high"), F.countDistinct(no).alias("different")
    )


@register(
    "read_corpus",
    "SELECT txt, style, split, count(*) AS n FROM v_corpus GROUP BY ALL",
)
def read_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    V.corpus_quality(spark, sf).select("txt", "style", "split").write.csv(
        path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    back = S.read_corpus(spark, path)
    return back.groupBy("txt", "style", "split").agg(F.count(F.lit(1)).alias("n"))


@register(
    "read_vectors",
    """SELECT vec_id::VARCHAR AS word, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""",
)
def read_vectors(spark, sf):
    row = F.concat_ws(" ", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("double").cast("string")))
    path = _text_file(V.table(spark, sf, "embeddings").select(row.alias("value")), spark, "vectors")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return S.read_vectors(spark, path).select("word", F.size("vec").alias("dim"), F.round(total, 4).alias("total"))


@register("discover_refs", "SELECT i AS file_no, n FROM (VALUES (0), (1)) f(i), (SELECT count(*) AS n FROM v_doc_lines)")
def discover_refs(spark, sf):
    """Two reference files found by their stem, with their line counts."""
    stem = scratch_path(spark, "refs")
    lines = V.lines(spark, sf).select("txt")
    for i in range(2):
        lines.write.option("compression", "gzip").text(f"{stem}{i}")
    found = [
        S.read_lines(spark, p).agg(F.lit(i).alias("file_no"), F.count(F.lit(1)).alias("n"))
        for i, p in enumerate(S.discover_refs(spark, stem))
    ]
    return found[0].unionByName(found[1])


# ---- streams


def _stream_lines(spark, sf):
    schema = V.table(spark, sf, "documents").schema
    # as a pattern the path may name one file as well as a folder of part files
    return ST.stream_lines(spark, f"{sf}/[d]ocuments.parquet", "parquet", schema)


@register("stream_lines", "SELECT row_id, txt FROM v_doc_lines")
def stream_lines(spark, sf):
    return ST.run_available(V.lines_of(_stream_lines(spark, sf)), "lines")


@register("stream_tag", "SELECT row_id, style, split, orig, tagged FROM v_tagged0")
def stream_tag(spark, sf):
    """Documents arrive as a stream and are styled by a join with the fixed labels."""
    corpus = V.quality_of(_stream_lines(spark, sf), V.table(spark, sf, "labels"))
    return ST.run_available(corpus, "tagged", ST.stream_tag(V.lexicon(spark, sf)))


view("v_lt", f"SELECT row_id, {tokens('txt')} || ['<eos>'] AS t FROM v_doc_lines")


@register(
    "stream_prepare",
    """SELECT row_id, string_agg(coalesce(id, 3)::VARCHAR, ' ' ORDER BY i) AS ids FROM (
      SELECT row_id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM v_lt)
    LEFT JOIN v_vocab USING (token) GROUP BY row_id""",
)
def stream_prepare(spark, sf):
    lines = V.lines_of(_stream_lines(spark, sf))
    done = ST.run_available(lines, "prepared", ST.stream_prepare(V.vocab(spark, sf)))
    return done.select("row_id", ids_text("ids").alias("ids"))
