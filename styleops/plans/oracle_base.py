"""SQL twins of the shared tables, for an independent check in DuckDB."""

from __future__ import annotations

import re

from styleops.functions.text import WHITESPACE as WS

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def closure(sql: str) -> list[str]:
    """Names of the views a statement needs, in the order they were defined."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\bv_\w+", todo.pop()))
        for name in words & VIEWS.keys() - need:
            need.add(name)
            todo.append(VIEWS[name])
    return [name for name in VIEWS if name in need]


def query(sql: str) -> str:
    views = closure(sql)
    if not views:
        return sql
    parts = [f"{name} AS MATERIALIZED (\n{VIEWS[name]}\n)" for name in views]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{WS}+', ''), '{WS}+\z', '')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+\z', '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def draw(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT / 4294967296.0)"


def squeeze(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({x}, '  ', ' '), '\A ', ''), ' \z', '')"


def untag(x: str, style: str) -> str:
    """Style labels here are plain letters and digits, so they need no escaping."""
    return rf"regexp_replace({x}, '\[' || {style} || '[0-9]*\]', '', 'g')"


def split_of(key: str) -> str:
    return f"CASE WHEN {key} % 10 = 0 THEN 'test' WHEN {key} % 10 = 1 THEN 'val' ELSE 'train' END"


view(
    "v_doc_lines",
    f"""SELECT doc_id * 100000 + i - 1 AS row_id, doc_id, txt FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS txt,
             generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents) WHERE {strip('txt')} <> ''""",
)
view(
    "v_corpus",
    f"""SELECT row_id, txt, 'q' || quality AS style, {split_of('doc_id')} AS split
    FROM v_doc_lines JOIN labels USING (doc_id)""",
)
view(
    "v_roles",
    f"""SELECT (conv_id * 100 + turn) * 10000 + i - 1 AS row_id, txt, role AS style,
           {split_of('conv_id')} AS split
    FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS txt,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
    WHERE {strip('txt')} <> ''""",
)
view("v_used", "SELECT * FROM v_corpus WHERE split IS DISTINCT FROM 'test'")
view(
    "v_tf",
    f"""SELECT style, row_id, term, count(*) AS tf FROM (
      SELECT style, row_id, unnest(list_concat(w, list_transform(range(1, len(w)),
             lambda i: w[i] || ' ' || w[i + 1]))) AS term
      FROM (SELECT style, row_id, {words('txt')} AS w FROM v_used))
    GROUP BY ALL""",
)
view("v_sizes", "SELECT style, count(*) AS n_docs FROM v_used GROUP BY style")
view(
    "v_idf",
    """SELECT style, term, freq, df, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM (
      SELECT style, term, sum(tf)::BIGINT AS freq, count(*) AS df FROM v_tf GROUP BY ALL)
    JOIN v_sizes USING (style)""",
)
view(
    "v_weights",
    """SELECT style, row_id, term,
           raw / sqrt(sum(raw * raw) OVER (PARTITION BY style, row_id)) AS weight
    FROM (SELECT style, row_id, term, tf * idf AS raw FROM v_tf JOIN v_idf USING (style, term))""",
)
view(
    "v_means",
    """SELECT style, term, total / n_docs AS mean_tfidf FROM (
      SELECT style, term, sum(weight) AS total FROM v_weights GROUP BY ALL)
    JOIN v_sizes USING (style)""",
)
view("v_stats", "SELECT * FROM v_idf JOIN v_means USING (style, term)")
view(
    "v_report",
    """SELECT m.style AS main_style, r.style AS rel_style, term, m.freq, m.mean_tfidf AS main_mean,
           r.mean_tfidf AS rel_mean, m.idf AS main_idf, r.idf AS rel_idf
    FROM v_stats m JOIN v_stats r USING (term) WHERE m.style <> r.style AND m.freq >= 2""",
)
view("v_ratio", "SELECT *, round(main_mean / rel_mean, 9) AS ratio FROM v_report")
view(
    "v_prob",
    """SELECT *, p / sum(p) OVER (PARTITION BY main_style) AS prob FROM (
      SELECT *, pow(ratio / sum(ratio) OVER (PARTITION BY main_style), 0.75) AS p FROM v_ratio)""",
)
view(
    "v_ranked",
    """SELECT *, (rank() OVER (PARTITION BY main_style ORDER BY ratio)
           + (count(*) OVER (PARTITION BY main_style, ratio) - 1) / 2)
           / count(*) OVER (PARTITION BY main_style) AS rank FROM v_prob""",
)
view(
    "v_lexicon",
    """SELECT main_style, term, freq, ratio, prob, rank, (rank - 0.90::DOUBLE) / (1 - 0.90::DOUBLE) AS score
    FROM v_ranked WHERE rank >= 0.90::DOUBLE""",
)
view(
    "v_toks",
    f"""SELECT *, {tokens('orig')} AS t, len({tokens('orig')}) AS n FROM (
      SELECT row_id, style, split, replace({strip('txt')}, chr(10), '') AS orig FROM v_corpus)""",
)
view(
    "v_cand",
    """SELECT style, row_id, i, k, array_to_string(t[i + 1 : i + k], ' ') AS phrase FROM (
      SELECT style, row_id, t, unnest(range(n))::INT AS i FROM v_toks), (VALUES (1), (2), (3), (4)) w(k)""",
)


def tagged_views(seed: int) -> None:
    """Hits, walk and text of one seed; the walk goes position by position."""
    view(
        f"v_hits{seed}",
        f"""SELECT c.style, c.row_id, c.i, max(c.k) AS k FROM v_cand c
        JOIN v_lexicon l ON l.main_style = c.style AND l.term = c.phrase
        WHERE {draw('c.row_id', 'c.i', 'c.k', str(seed))} < l.score GROUP BY ALL""",
    )
    view(
        f"v_walk{seed}",
        f"""SELECT row_id, -1 AS i, 0 AS nxt, false AS prev, NULL::VARCHAR AS piece FROM v_toks
        UNION ALL
        SELECT w.row_id, w.nxt, w.nxt + coalesce(h.k, 1), h.k IS NOT NULL,
               CASE WHEN h.k IS NULL THEN s.t[w.nxt + 1] WHEN w.prev THEN NULL
                    ELSE '[' || s.style || least(w.nxt // 3, 20) || ']' END
        FROM v_walk{seed} w JOIN v_toks s ON s.row_id = w.row_id
        LEFT JOIN v_hits{seed} h ON h.row_id = w.row_id AND h.i = w.nxt
        WHERE w.nxt < s.n""",
    )
    view(
        f"v_tagged{seed}",
        f"""SELECT s.row_id, s.style, s.split, s.orig, coalesce(p.tagged, '') AS tagged FROM v_toks s
        LEFT JOIN (SELECT row_id, string_agg(piece, ' ' ORDER BY i) AS tagged FROM v_walk{seed}
                   WHERE piece IS NOT NULL GROUP BY row_id) p USING (row_id)""",
    )


tagged_views(0)
view("v_kept", "SELECT * FROM v_tagged0 WHERE contains(tagged, style)")
view(
    "v_pairs",
    f"""SELECT row_id AS pair_id, {squeeze(squeeze(untag('tagged', 'style')))} AS hyp,
           [orig, array_to_string(list_filter({tokens('orig')}, lambda x, i: i % 5 <> 0), ' ')] AS refs
    FROM v_tagged0""",
)
