"""Queries over the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleops.operators.metrics import bleu as B
from styleops.operators.metrics import cider as CI
from styleops.operators.metrics import counts as N
from styleops.operators.metrics import embedding as E
from styleops.operators.metrics import meteor as M
from styleops.operators.metrics import report as R
from styleops.operators.metrics import rouge as RG
from styleops.plans import views as V
from styleops.plans.lexicon_queries import sql_13a
from styleops.plans.oracle_base import query, rstrip, tokens, view
from styleops.session import scratch_path
from styleops.sources import files as S

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = query(sql)
        return fn

    return add


def bleu_views(p: str, source: str) -> None:
    """n-gram counts and BLEU statistics of a pairs view."""
    view(
        f"v_side{p}",
        f"""SELECT pair_id, ref_no, {tokens('txt')} AS t FROM (
          SELECT pair_id, -1 AS ref_no, hyp AS txt FROM {source} UNION ALL
          SELECT pair_id, generate_subscripts(refs, 1) - 1, unnest(refs) FROM {source})""",
    )
    parts = [
        f"""SELECT pair_id, ref_no, {n} AS n, unnest(list_transform(range(1, len(t) - {n - 1} + 1),
            lambda i: {" || ' ' || ".join(f"t[i + {d}]" for d in range(n))})) AS gram FROM v_side{p}"""
        for n in range(1, 5)
    ]
    view(
        f"v_grams{p}",
        f"SELECT pair_id, ref_no, n, gram, count(*) AS cnt FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL",
    )
    correct = ", ".join(f"sum(CASE WHEN n = {n} THEN least(h, r) ELSE 0 END) AS correct_{n}" for n in range(1, 5))
    view(
        f"v_match{p}",
        f"""SELECT pair_id, {correct} FROM (
          SELECT pair_id, n, gram, max(CASE WHEN ref_no < 0 THEN cnt END) AS h,
                 max(CASE WHEN ref_no >= 0 THEN cnt END) AS r FROM v_grams{p} GROUP BY ALL)
        WHERE h IS NOT NULL AND r IS NOT NULL GROUP BY pair_id""",
    )
    guess = ", ".join(f"greatest(testlen - {n - 1}, 0) AS guess_{n}" for n in range(1, 5))
    keep = ", ".join(f"coalesce(correct_{n}, 0)::BIGINT AS correct_{n}" for n in range(1, 5))
    view(
        f"v_bstats{p}",
        f"""SELECT pair_id, testlen, closest, shortest, average, {guess}, {keep} FROM (
          SELECT h.pair_id, any_value(len(h.t)) AS testlen,
                 arg_min(len(r.t), abs(len(r.t) - len(h.t)) * 100000 + len(r.t))::DOUBLE AS closest,
                 min(len(r.t))::DOUBLE AS shortest, avg(len(r.t)) AS average
          FROM v_side{p} h JOIN v_side{p} r ON h.pair_id = r.pair_id AND h.ref_no < 0 AND r.ref_no >= 0
          GROUP BY h.pair_id) LEFT JOIN v_match{p} USING (pair_id)""",
    )
    sums = ", ".join(f"sum({c}_{n}) AS {c}_{n}" for c in ("guess", "correct") for n in range(1, 5))
    view(f"v_total{p}", f"SELECT sum(testlen) AS testlen, sum(closest) AS closest, {sums} FROM v_bstats{p}")


def bleu_sql(reflen: str) -> list[str]:
    out = []
    for n in range(1, 5):
        product = " * ".join(f"((correct_{k} + 1e-15) / (guess_{k} + 1e-9))" for k in range(1, n + 1))
        ratio = f"((testlen + 1e-15) / ({reflen} + 1e-9))"
        out.append(f"pow({product}, 1.0 / {n}) * CASE WHEN {ratio} < 1 THEN exp(1 - 1 / {ratio}) ELSE 1 END")
    return out


def bleu_list(reflen: str) -> str:
    return ", ".join(f"round({e}, 6) AS Bleu_{n}" for n, e in enumerate(bleu_sql(reflen), 1))


bleu_views("", "v_pairs")
STAT_NAMES = ", ".join(f"{c}_{n}" for c in ("guess", "correct") for n in range(1, 5))


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@register("metric_ngrams", "SELECT pair_id, ref_no::INT AS ref_no, n, gram, cnt FROM v_grams")
def metric_ngrams(spark, sf):
    return N.metric_ngrams(N.by_pair(V.eval_pairs(spark, sf)))


@register("bleu_stats", f"SELECT pair_id, testlen, closest AS reflen, {STAT_NAMES} FROM v_bstats")
def bleu_stats(spark, sf):
    return B.bleu_stats(V.eval_pairs(spark, sf))


@register("bleu_corpus", f"SELECT {bleu_list('closest')} FROM v_total")
def bleu_corpus(spark, sf):
    return rounded(B.bleu_corpus(B.bleu_stats(V.eval_pairs(spark, sf))), *R.BLEU)


@register("evaluate_files", f"SELECT {bleu_list('closest')} FROM v_total")
def evaluate_files(spark, sf):
    """Hypotheses and references written as line-aligned files, found by their stem, joined by line and scored."""
    path = scratch_path(spark, "evaluated")
    refs = [F.get("refs", F.lit(i)).alias(f"refs{i}") for i in range(2)]
    S.write_aligned(V.eval_pairs(spark, sf).select("pair_id", "hyp", *refs), [F.col("pair_id")], ["hyp", "refs0", "refs1"], path)
    found = [S.read_lines(spark, p) for p in S.discover_refs(spark, f"{path}/refs")]
    pairs = S.read_refs(found, S.read_lines(spark, f"{path}/hyp"))
    return rounded(B.bleu_corpus(B.bleu_stats(pairs)), *R.BLEU)


@register("bleu_sentence", f"SELECT pair_id, {bleu_list('closest')} FROM v_bstats")
def bleu_sentence(spark, sf):
    return rounded(B.bleu_sentence(B.bleu_stats(V.eval_pairs(spark, sf))), *R.BLEU)


@register(
    "bleu_reflen_options",
    "SELECT pair_id, shortest, average, closest FROM v_bstats",
)
def bleu_reflen_options(spark, sf):
    lengths = V.eval_pairs(spark, sf).select(
        "pair_id", N.n_tokens(F.col("hyp")).alias("testlen"), F.transform("refs", N.n_tokens).alias("lengths")
    )
    options = ["shortest", "average", "closest"]
    return lengths.select(
        "pair_id", *[B.reference_length(F.col("lengths"), F.col("testlen"), o).alias(o) for o in options]
    )


@register(
    "bleu_length_ratio",
    """SELECT 'closest' AS option, sum(testlen) AS testlen, sum(closest) AS reflen,
           round(sum(testlen) / sum(closest), 6) AS ratio FROM v_bstats
    UNION ALL SELECT 'given', sum(testlen), count(*) * 12.0, round(sum(testlen) / (count(*) * 12.0), 6) FROM v_bstats""",
)
def bleu_length_ratio(spark, sf):
    stats = B.bleu_stats(V.eval_pairs(spark, sf))
    both = B.bleu_length_ratio(stats).withColumn("option", F.lit("closest")).unionByName(
        B.bleu_length_ratio(stats, 12.0).withColumn("option", F.lit("given"))
    )
    return rounded(both, "ratio")


view("v_orig_pairs", "SELECT pair_id, refs[1] AS hyp, refs FROM v_pairs")
bleu_views("_orig", "v_orig_pairs")


@register(
    "bleu_merge",
    f"""SELECT {bleu_list('closest')} FROM (SELECT sum(testlen) AS testlen, sum(closest) AS closest,
      {", ".join(f"sum({c}_{n}) AS {c}_{n}" for c in ("guess", "correct") for n in range(1, 5))}
      FROM (SELECT * FROM v_bstats UNION ALL SELECT * FROM v_bstats_orig))""",
)
def bleu_merge(spark, sf):
    """The evaluated hypotheses merged with the originals scored against the same references."""
    pairs = V.eval_pairs(spark, sf)
    others = pairs.select("pair_id", F.get("refs", F.lit(0)).alias("hyp"))
    merged = B.bleu_merge(B.bleu_stats(pairs), B.bleu_retest(pairs, others))
    return rounded(B.bleu_corpus(merged), *R.BLEU)


view("v_low_pairs", "SELECT pair_id, lower(hyp) AS hyp, list_transform(refs, lambda r: lower(r)) AS refs FROM v_pairs")
bleu_views("_low", "v_low_pairs")


def multi_sql(view_name: str) -> str:
    ps = [f"CASE WHEN guess_{n} > 0 THEN correct_{n} / guess_{n} ELSE 0 END" for n in range(1, 5)]
    logs = " + ".join(f"CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999 END" for p in ps)
    bp = "CASE WHEN testlen < closest THEN exp(1 - closest / testlen) ELSE 1 END"
    cols = ", ".join(f"round({p}, 6) AS p{n}" for n, p in enumerate(ps, 1))
    return f"""SELECT round(({bp}) * exp(({logs}) / 4), 6) AS bleu, {cols}, round({bp}, 6) AS bp,
      round(testlen / closest, 6) AS ratio, testlen::BIGINT AS hyp_len, closest::BIGINT AS ref_len FROM {view_name}"""


MULTI = ["bleu", "p1", "p2", "p3", "p4", "bp", "ratio"]


@register("multi_bleu", multi_sql("v_total"))
def multi_bleu(spark, sf):
    return rounded(B.multi_bleu(V.eval_pairs(spark, sf)), *MULTI)


@register("multi_bleu_lowercase", multi_sql("v_total_low"))
def multi_bleu_lowercase(spark, sf):
    return rounded(B.multi_bleu(N.fold_case(V.eval_pairs(spark, sf))), *MULTI)


view(
    "v_13a_pairs",
    f"""SELECT pair_id, {sql_13a(rstrip('hyp'))} AS hyp,
      [{sql_13a(rstrip('refs[1]'))}, {sql_13a(rstrip('refs[2]'))}] AS refs FROM v_pairs""",
)
bleu_views("_13a", "v_13a_pairs")
_P13 = []
for _n in range(1, 5):
    _zeros = " + ".join(f"(correct_{k} = 0 AND guess_{k} > 0)::INT" for k in range(1, _n + 1))
    _P13.append(
        f"CASE WHEN guess_{_n} = 0 THEN 0 WHEN correct_{_n} = 0 THEN 1 / (pow(2.0, {_zeros}) * guess_{_n})"
        f" ELSE correct_{_n} / guess_{_n} END"
    )
_LOGS = " + ".join(f"CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999 END" for p in _P13)


@register(
    "bleu_13a",
    f"""SELECT round(100 * CASE WHEN testlen < closest THEN exp(1 - closest / testlen) ELSE 1 END
      * exp(({_LOGS}) / 4), 6) AS bleu FROM v_total_13a""",
)
def bleu_13a(spark, sf):
    return rounded(B.bleu_13a(V.eval_pairs(spark, sf)), "bleu")


LIMB = (1 << 60) - 1


def rouge_views(p: str, source: str) -> None:
    """The longest common subsequence by rows of bits, 60 to a number.

    A bit of the row is cleared where the best length grows at that reference place. For each hypothesis token, m being the bits of its
    places in the reference, the row v becomes (v + (v & m)) | (v & ~m), with the carry handed on from number to number.
    """
    view(
        f"v_sp{p}",
        f"""SELECT pair_id, ref_no, string_split(hyp, ' ') AS h, string_split(ref, ' ') AS r FROM (
          SELECT pair_id, hyp, generate_subscripts(refs, 1) - 1 AS ref_no, unnest(refs) AS ref FROM {source})""",
    )
    view(
        f"v_places{p}",
        f"""SELECT pair_id, ref_no, word, pos // 60 AS limb, sum(1::BIGINT << (pos % 60))::BIGINT AS bits
        FROM (SELECT pair_id, ref_no, generate_subscripts(r, 1) - 1 AS pos, unnest(r) AS word FROM v_sp{p}) GROUP BY ALL""",
    )
    view(
        f"v_bits{p}",
        f"""SELECT w.pair_id, w.ref_no, w.word, list(coalesce(bits, 0) ORDER BY w.limb) AS m FROM (
          SELECT pair_id, ref_no, word, unnest(range((len(r) + 59) // 60)) AS limb
          FROM (SELECT DISTINCT pair_id, ref_no, word FROM v_places{p}) JOIN v_sp{p} USING (pair_id, ref_no)) w
        LEFT JOIN v_places{p} b ON b.pair_id = w.pair_id AND b.ref_no = w.ref_no AND b.word = w.word AND b.limb = w.limb GROUP BY ALL""",
    )
    view(
        f"v_steps{p}",
        f"""SELECT pair_id, ref_no, list(m ORDER BY pos) AS steps
        FROM (SELECT pair_id, ref_no, generate_subscripts(h, 1) AS pos, unnest(h) AS word FROM v_sp{p}) JOIN v_bits{p} USING (pair_id, ref_no, word)
        GROUP BY ALL""",
    )
    add = "(s[1] + e[1] + e[2])"
    carried = f"list_concat([{add} >> 60], s[2:], [({add} & {LIMB}) | (e[1] - e[2])])"
    cells = "list_transform(range(1, len(v) + 1), lambda k: [v[k], v[k] & m[k]])"
    row = f"list_reduce(list_prepend([0::BIGINT], {cells}), lambda s, e: {carried})[2:]"
    view(
        f"v_lcs{p}",
        f"""SELECT pair_id, ref_no::INT AS ref_no, len(h)::INT AS hyp_len, len(r)::INT AS ref_len,
          coalesce(list_sum(list_transform(list_reduce(list_prepend(list_transform(steps[1], lambda x: {LIMB}::BIGINT), steps), lambda v, m: {row}),
            lambda x: 60 - bit_count(x))), 0)::BIGINT AS lcs
        FROM v_sp{p} LEFT JOIN v_steps{p} USING (pair_id, ref_no)""",
    )
    view(
        f"v_rouge{p}",
        f"""SELECT pair_id, CASE WHEN p > 0 AND r > 0 THEN (1 + 1.44) * p * r / (r + 1.44 * p) ELSE 0 END AS ROUGE_L FROM (
          SELECT pair_id, max(lcs / hyp_len) AS p, max(lcs / ref_len) AS r FROM v_lcs{p} GROUP BY pair_id)""",
    )


rouge_views("", "v_pairs")


@register("lcs_length", "SELECT pair_id, ref_no, hyp_len, ref_len, lcs FROM v_lcs")
def lcs_length(spark, sf):
    return RG.lcs_lengths(V.eval_pairs(spark, sf))


@register("rouge_l", "SELECT pair_id, round(ROUGE_L, 6) AS ROUGE_L FROM v_rouge")
def rouge_l(spark, sf):
    return rounded(RG.rouge_l(V.eval_pairs(spark, sf)), "ROUGE_L")


def cider_views(p: str, source: str, n_refs: int) -> None:
    view(f"v_df{p}", f"SELECT n, gram, count(DISTINCT pair_id) AS df FROM v_grams{p} WHERE ref_no >= 0 GROUP BY ALL")
    view(
        f"v_w{p}",
        f"""SELECT pair_id, ref_no, n, gram, cnt,
          cnt * (ln((SELECT count(*) FROM {source})::DOUBLE) - ln(greatest(1, coalesce(df, 0))::DOUBLE)) AS w
        FROM v_grams{p} LEFT JOIN v_df{p} USING (n, gram)""",
    )
    view(f"v_norm{p}", f"SELECT pair_id, ref_no, n, sqrt(sum(w * w)) AS norm, sum(cnt) AS len FROM v_w{p} GROUP BY ALL")
    view(
        f"v_dot{p}",
        f"""SELECT h.pair_id, r.ref_no, h.n, sum(least(h.w, r.w) * r.w) AS dot FROM v_w{p} h
        JOIN v_w{p} r ON h.pair_id = r.pair_id AND h.n = r.n AND h.gram = r.gram AND h.ref_no < 0 AND r.ref_no >= 0
        GROUP BY ALL""",
    )
    view(
        f"v_gap{p}",
        f"""SELECT s.pair_id, s.ref_no, coalesce(h.len, 0) - coalesce(r.len, 0) AS gap
        FROM (SELECT pair_id, ref_no FROM v_side{p} WHERE ref_no >= 0) s
        LEFT JOIN v_norm{p} h ON h.pair_id = s.pair_id AND h.ref_no < 0 AND h.n = 2
        LEFT JOIN v_norm{p} r ON r.pair_id = s.pair_id AND r.ref_no = s.ref_no AND r.n = 2""",
    )
    view(
        f"v_cider{p}",
        f"""SELECT g.pair_id, 10 * sum(coalesce(c.total, 0) * exp(-(gap * gap) / 72.0) / 4) / {n_refs} AS CIDEr FROM v_gap{p} g
        LEFT JOIN (SELECT d.pair_id, d.ref_no, sum(CASE WHEN h.norm > 0 AND r.norm > 0
                     THEN dot / (h.norm * r.norm) ELSE 0 END) AS total
                   FROM v_dot{p} d JOIN v_norm{p} h ON h.pair_id = d.pair_id AND h.n = d.n AND h.ref_no < 0
                   JOIN v_norm{p} r ON r.pair_id = d.pair_id AND r.n = d.n AND r.ref_no = d.ref_no
                   GROUP BY ALL) c ON c.pair_id = g.pair_id AND c.ref_no = g.ref_no
        GROUP BY g.pair_id""",
    )


cider_views("", "v_pairs", 2)


@register("cider_df", "SELECT n, gram, df FROM v_df")
def cider_df(spark, sf):
    return CI.cider_df(V.eval_pairs(spark, sf))


@register("cider", "SELECT pair_id, round(CIDEr, 6) AS CIDEr FROM v_cider")
def cider(spark, sf):
    return rounded(CI.cider(V.eval_pairs(spark, sf)), "CIDEr")


def meteor_views(p: str, source: str) -> None:
    view(
        f"v_mwords{p}",
        f"""SELECT pair_id, ref_no, side, pos, word,
          row_number() OVER (PARTITION BY pair_id, ref_no, side, word ORDER BY pos) AS o FROM (
          SELECT pair_id, ref_no, 'h' AS side, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM (
            SELECT pair_id, unnest(range(len(refs))) AS ref_no, {tokens("replace(replace(hyp, '|||', ''), '  ', ' ')")} AS t FROM {source})
          UNION ALL
          SELECT pair_id, ref_no, 'r', generate_subscripts(t, 1), unnest(t) FROM v_side{p} WHERE ref_no >= 0)""",
    )
    view(
        f"v_align{p}",
        f"""SELECT h.pair_id, h.ref_no, h.pos AS hp, r.pos AS rp FROM v_mwords{p} h JOIN v_mwords{p} r
        ON h.pair_id = r.pair_id AND h.ref_no = r.ref_no AND h.word = r.word AND h.o = r.o
        AND h.side = 'h' AND r.side = 'r'""",
    )
    view(
        f"v_chunks{p}",
        f"""SELECT pair_id, ref_no, count(*) AS m, sum(brk) AS ch FROM (
          SELECT *, CASE WHEN hp = lag(hp) OVER w + 1 AND rp = lag(rp) OVER w + 1 THEN 0 ELSE 1 END AS brk
          FROM v_align{p} WINDOW w AS (PARTITION BY pair_id, ref_no ORDER BY hp)) GROUP BY ALL""",
    )
    view(
        f"v_meteor{p}",
        f"""SELECT pair_id, max(CASE WHEN m IS NULL THEN 0 ELSE p * r / (0.85 * p + (1 - 0.85) * r)
          * (1 - CASE WHEN same THEN 0 ELSE 0.6 * pow(ch / m, 0.2) END) END) AS METEOR FROM (
          SELECT s.pair_id, s.ref_no, m, ch, m / len(h.t) AS p, m / len(s.t) AS r, h.t = s.t AS same
          FROM v_side{p} s JOIN v_side{p} h ON h.pair_id = s.pair_id AND h.ref_no < 0
          LEFT JOIN v_chunks{p} c ON c.pair_id = s.pair_id AND c.ref_no = s.ref_no WHERE s.ref_no >= 0)
        GROUP BY pair_id""",
    )


meteor_views("", "v_pairs")


@register("meteor_exact", "SELECT pair_id, round(METEOR, 6) AS METEOR FROM v_meteor")
def meteor_exact(spark, sf):
    return rounded(M.meteor_exact(V.eval_pairs(spark, sf)), "METEOR")


view(
    "v_wfreq",
    f"SELECT word, count(*) AS freq FROM (SELECT unnest({tokens('txt')}) AS word FROM v_corpus) GROUP BY word",
)
view(
    "v_vectors",
    """SELECT vec_id AS id, word, embedding::DOUBLE[] AS vec, freq FROM (
      SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS vec_id FROM v_wfreq)
    JOIN embeddings USING (vec_id)""",
)
view(
    "v_unknown",
    """SELECT list(x ORDER BY d) AS vec FROM (SELECT d, avg(x) AS x FROM (
      SELECT generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v_vectors) GROUP BY d)""",
)
view("v_allvec", "SELECT id, vec FROM v_vectors UNION ALL SELECT -1, vec FROM v_unknown")
view(
    "v_items",
    """SELECT pair_id, ref_no, coalesce(id, -1) AS id, sum(cnt) AS cnt FROM v_grams
    LEFT JOIN v_vectors ON word = gram WHERE n = 1 GROUP BY ALL""",
)
view(
    "v_dims",
    """SELECT pair_id, ref_no, d, sum(cnt * x) AS s, max(x) AS hi, min(x) AS lo FROM v_items JOIN (
      SELECT id, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v_allvec) USING (id) GROUP BY ALL""",
)
view(
    "v_extrema",
    "SELECT pair_id, ref_no, d, s, CASE WHEN lo > 0 OR (lo < 0 AND -lo < hi) THEN hi ELSE lo END AS e FROM v_dims",
)


def cos_view(col: str, name: str) -> str:
    return f"""SELECT p.pair_id, coalesce(max(c), 0) AS {name} FROM v_pairs p LEFT JOIN (
      SELECT h.pair_id, r.ref_no,
        CASE WHEN sum(h.{col} * h.{col}) > 0 AND sum(r.{col} * r.{col}) > 0 THEN
        sum(h.{col} * r.{col}) / (sqrt(sum(h.{col} * h.{col})) * sqrt(sum(r.{col} * r.{col}))) ELSE 0 END AS c
      FROM v_extrema h JOIN v_extrema r ON h.pair_id = r.pair_id AND h.d = r.d AND h.ref_no < 0 AND r.ref_no >= 0
      GROUP BY ALL) c ON c.pair_id = p.pair_id GROUP BY p.pair_id"""


view("v_avg", cos_view("s", "EmbeddingAverageCosineSimilairty"))
view("v_ext", cos_view("e", "VectorExtremaCosineSimilarity"))
view(
    "v_sim",
    "SELECT a.id AS a, b.id AS b, coalesce(list_cosine_similarity(a.vec, b.vec), 0) AS sim FROM v_allvec a, v_allvec b",
)
view(
    "v_best",
    """SELECT h.pair_id, r.ref_no, h.id AS hid, r.id AS rid, h.cnt AS hc, r.cnt AS rc, sim FROM v_items h
    JOIN v_items r ON h.pair_id = r.pair_id AND h.ref_no < 0 AND r.ref_no >= 0
    JOIN v_sim ON a = h.id AND b = r.id""",
)
view(
    "v_greedy",
    """SELECT p.pair_id, coalesce(max((x.s + y.s) / 2), 0) AS GreedyMatchingScore FROM v_pairs p
    LEFT JOIN (SELECT pair_id, ref_no, sum(c * m) / sum(c) AS s FROM (
        SELECT pair_id, ref_no, hid, any_value(hc) AS c, max(sim) AS m FROM v_best GROUP BY ALL) GROUP BY ALL) x
      ON x.pair_id = p.pair_id
    LEFT JOIN (SELECT pair_id, ref_no, sum(c * m) / sum(c) AS s FROM (
        SELECT pair_id, ref_no, rid, any_value(rc) AS c, max(sim) AS m FROM v_best GROUP BY ALL) GROUP BY ALL) y
      ON y.pair_id = p.pair_id AND y.ref_no = x.ref_no GROUP BY p.pair_id""",
)
EMBED = {
    "embedding_average": ("EmbeddingAverageCosineSimilairty", "v_avg"),
    "vector_extrema": ("VectorExtremaCosineSimilarity", "v_ext"),
    "greedy_matching": ("GreedyMatchingScore", "v_greedy"),
}


def _embedding(name: str, measure: str, source: str) -> None:
    @register(name, f"SELECT pair_id, round({measure}, 6) AS {measure} FROM {source}")
    def run(spark, sf):
        scores = E.embedding_scores(V.eval_pairs(spark, sf), V.word_vectors(spark, sf), [measure])
        return rounded(scores, measure)


for _name, (_measure, _source) in EMBED.items():
    _embedding(_name, _measure, _source)


def overlap_rows(p: str) -> str:
    rows = [f"SELECT 'Bleu_{n}' AS metric, {e} AS value FROM v_total{p}" for n, e in enumerate(bleu_sql("closest"), 1)]
    for name, source in (("METEOR", "v_meteor"), ("ROUGE_L", "v_rouge"), ("CIDEr", "v_cider")):
        rows.append(f"SELECT '{name}', avg({name}) FROM {source}{p}")
    return " UNION ALL ".join(rows)


OVERLAP_ROWS = overlap_rows("")
EMBED_ROWS = " UNION ALL ".join(f"SELECT '{measure}', avg({measure}) FROM {source}" for measure, source in EMBED.values())
METRIC_ROWS = f"SELECT * FROM ({OVERLAP_ROWS} UNION ALL {EMBED_ROWS}) WHERE metric NOT IN ('Bleu_3', 'Bleu_4', 'ROUGE_L')"


@register("compute_metrics", f"SELECT metric, round(value, 6) AS value FROM ({OVERLAP_ROWS} UNION ALL {EMBED_ROWS})")
def compute_metrics(spark, sf):
    return rounded(R.compute_metrics(V.eval_pairs(spark, sf), V.word_vectors(spark, sf)), "value")


@register(
    "compute_individual_metrics",
    f"""SELECT pair_id, {bleu_list('closest')}, round(METEOR, 6) AS METEOR, round(ROUGE_L, 6) AS ROUGE_L, 0.0::DOUBLE AS CIDEr,
      {", ".join(f"round({measure}, 6) AS {measure}" for measure, _ in EMBED.values())}
    FROM v_bstats JOIN v_meteor USING (pair_id) JOIN v_rouge USING (pair_id)
      {" ".join(f"JOIN {source} USING (pair_id)" for _, source in EMBED.values())}""",
)
def compute_individual_metrics(spark, sf):
    scores = R.compute_individual_metrics(V.eval_pairs(spark, sf), V.word_vectors(spark, sf))
    return rounded(scores, *R.ALL)


def _omitted(spark, sf):
    return R.compute_metrics(V.eval_pairs(spark, sf), V.word_vectors(spark, sf), omit=["Bleu_3", "ROUGE_L"])


@register("metrics_to_omit", f"SELECT metric, round(value, 6) AS value FROM ({METRIC_ROWS})")
def metrics_to_omit(spark, sf):
    return rounded(_omitted(spark, sf), "value")


@register(
    "metrics_report",
    f"SELECT printf('%s: %.6f', metric, value) AS line FROM ({METRIC_ROWS})",
)
def metrics_report(spark, sf):
    return R.metrics_report(_omitted(spark, sf))


view("v_one_pairs", "SELECT pair_id, hyp, refs[1:1] AS refs FROM v_pairs")
bleu_views("_one", "v_one_pairs")
cider_views("_one", "v_one_pairs", 1)
meteor_views("_one", "v_one_pairs")
rouge_views("_one", "v_one_pairs")


@register("context_scores", f"SELECT metric, round(value, 6) AS value FROM ({overlap_rows('_one')})")
def context_scores(spark, sf):
    return rounded(R.context_scores(V.eval_pairs(spark, sf)), "value")
