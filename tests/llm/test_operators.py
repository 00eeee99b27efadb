"""The operators for training data against brute force, on odd rows and on the smallest tables."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from styleops.llm import byte_bpe, chunks, embedding_dedup, exact_dedup, html_text, jaccard_join, packing, queries, quality, sharding, substring_dedup, token_counts
from styleops.llm.common import table
from styleops.session import scratch_path

WORD, BYTE, RANKS = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
LONG = " ".join(f"w{k % 977}" for k in range(30_000)) + " " + "x" * 5000
ODD = [
    (1, "One two three four five six seven."), (2, "ONE two three four five six seven."), (3, None), (4, ""), (5, "  \n "), (6, "a  b\t c \n\nd e"),
    (7, "<|endoftext|> in text<|ENDOFTEXT|>"), (8, LONG), (9, "É é ñ 你好 🙂 it's we'll 12345 !!??"), (10, "\n\nlead"), (11, "tail \n"), (12, "a\x00b"),
    (None, "One two three four five six seven."), (None, None), (1, "One two three four five six seven."), (13, "two words"), (14, "two words"),
]
DOCS = "doc_id long, text string, lang string, _rank long, norm string, bucket int, removed string, cell string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, 5, "x", 1, "y", "z") for i, t in ODD], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, sf, name):
    from check import compare, duck

    assert compare(spark, duck(sf), sf, name).startswith("ok")


def test_exact_groups_of_odd_rows(odd, none):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(odd).collect()}
    same = hashlib.sha256(ODD[0][1].lower().encode()).hexdigest()
    assert rows[1, same].keep_id == 2 and rows[2, same].kept and rows[2, same].group_size == 4 and not rows[None, same].kept
    assert rows[3, hashlib.sha256(b"").hexdigest()].keep_id == 4
    assert exact_dedup.exact_groups(odd).count() == len(ODD) and exact_dedup.exact_groups(none).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(odd).collect()} == {2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14}


def test_one_row_of_each_text_stays(spark, none):
    rows = [
        (None, "no id", "b"), (None, "No id", "a"), (None, "alone", "c"), (None, "has id", "d"), (7, "has id", "e"),
        (1, "loaded twice", "f"), (1, "loaded twice", "f"), (1, "LOADED twice", "g"), (0, "loaded twice", "h"),
        (2, "kept", "i"), (2, "other", "j"), (3, "other", "k"), (None, None, "l"), (None, "", "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = sorted((tuple(r) for r in exact_dedup.drop_exact_copies(docs).collect()), key=str)
    want = [(None, "No id", "a"), (None, "alone", "c"), (7, "has id", "e"), (1, "LOADED twice", "g"), (2, "kept", "i"), (3, "other", "k")]
    assert [r for r in got if r[2] not in "lm"] == sorted(want, key=str) and len(got) == len(want) + 1
    assert exact_dedup.drop_exact_copies(none).count() == 0 and exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_exact_hot_text_is_split(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.exact_groups(docs).filter("group_size > 1")
    assert [tuple(r) for r in out.groupBy("keep_id", "group_size").count().collect()] == [(5997, 2000, 2000)]
    assert exact_dedup.content_runs(docs).filter("head IS NOT NULL").count() == 2


def test_neighbours_find_all_copies(spark, sf):
    """Without a hot text every group is one run of the sort, so all copies are found by comparing neighbours."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    runs = exact_dedup.content_runs(docs).collect()
    sizes = {}
    for r in runs:
        sizes[r.text_sha256] = sizes.get(r.text_sha256, 0) + 1
    assert all(r.run_size == sizes[r.text_sha256] and r.head is None for r in runs)
    assert sum(r.run_size > 1 for r in runs) > 20


def test_lookup_table_equals_sql_and_is_even():
    found = dict(duckdb.sql(queries.table_sql(101)).fetchall())
    assert [found[k] for k in range(101)] == sharding.lookup_table(queries.SHARDS, 101)
    counts = np.unique(sharding.lookup_table(queries.SHARDS), return_counts=True)[1]
    assert len(counts) == 32 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(queries.SHARDS[:-1])
    moved = [a != b for a, b in zip(sharding.lookup_table(queries.SHARDS), fewer, strict=True)]
    assert sum(moved) < 0.25 * len(fewer)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_sharding_of_odd_rows(spark, odd, none):
    rows = sharding.place(odd, "doc_id", queries.SHARDS)
    assert rows.count() == len(ODD) and set(odd.columns) < set(rows.columns) and sharding.place(none, "doc_id", queries.SHARDS).count() == 0
    path = scratch_path(spark, "shards")
    sharding.write_shards(rows.select("doc_id", "shard"), path, 2)
    assert spark.read.parquet(path).count() == len(ODD)


def test_token_counts_and_cache(spark, odd, none, sf):
    from tokenizers import Tokenizer

    library, cache = Tokenizer.from_file(WORD), scratch_path(spark, "cache")
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, WORD, cache).collect())
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t in ODD)
    assert got == want
    stored = spark.read.parquet(cache).count()
    token_counts.count_tokens(odd, WORD, cache).collect()
    assert spark.read.parquet(cache).count() == stored == len({(t or "").strip(" ") for _, t in ODD})
    assert token_counts.count_tokens(none, WORD, cache).count() == 0
    rows = {r.doc_id: r for r in queries.op2_token_counts(spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].over_limit, rows[i].n_bytes) == (n, n > 2048, len(t.encode()))


def test_ids_of_chunks_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for _, t in ODD:
        assert chunks.encode_texts(BYTE, [t or ""])[0] == np.asarray(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def placed_rightly(rows, ids_of, capacity=2048):
    spans, fill = {}, {}
    for r in rows:
        ids = ids_of[r.doc_id]
        assert zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, whole in [*((p, len(ids_of[i])) for i, p in spans.items()), *((p, None) for p in fill.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at <= capacity if whole is None else at == whole
    return fill


def test_packing(spark, odd, none, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark, sf).items()}
    rows = queries.op3_packing(spark, sf).collect()
    fill = placed_rightly(rows, ids)
    assert set(ids) == {r.doc_id for r in rows} and len(fill) < 1.1 * sum(map(len, ids.values())) / 2048 + 2
    assert {r.doc_id for r in packing.packed(odd, BYTE).collect()} == {i for i, _ in ODD} and packing.packed(none, BYTE).count() == 0
    whole = packing.sequences(packing.pack(packing.pieces(odd, BYTE), 10)).collect()
    assert all((n := len(r.ids) // 4) == 2048 or n & (n - 1) == 0 for r in whole)


def test_sum_of_squares_rule():
    rng = random.Random(3)
    sizes = [rng.randint(1, 40) for _ in range(3000)]
    window, offset, n = packing.sum_of_squares(np.asarray(sizes), 40)
    used = np.zeros(n, int)
    np.add.at(used, window, sizes)
    assert used.max() <= 40 and n <= 1.03 * sum(sizes) / 40 + 1
    for w in range(0, n, 50):
        parts = sorted((offset[k], sizes[k]) for k in np.flatnonzero(window == w))
        assert [p for p, _ in parts] == [0, *np.cumsum([s for _, s in parts])[:-1]]


def test_byte_bpe_equals_the_library(spark, odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = byte_bpe.merges_of(RANKS)
    rng = random.Random(5)
    words = ["".join(rng.choice("aabcdetnhio  éß12..'") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    words = [w for x in words for w in byte_bpe._splitter(P.PATTERN).findall(x)]
    made = byte_bpe.replay([w.encode() for w in words], merges)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in made] == [library.encode_ordinary(w) for w in words]
    rows = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in ODD)
    assert sorted(bytes(r.ids) for r in rows) == sorted(np.asarray(library.encode_ordinary(t or ""), "<u4").tobytes() for _, t in ODD)
    both = byte_bpe.encode(odd, RANKS, P.PATTERN, decoded=True).collect()
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in both) == sorted((bytes(r.ids), bytes(r.decoded)) for r in rows)
    assert byte_bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows) > 0
    noisy = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema))
    out = quality.quality_scores(odd, noisy).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def shingle_groups(rows):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().split()) else frozenset()) for i, t in rows]
    group = list(range(len(sets)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 4 * len(x) <= 5 * len(y) and 4 * len(y) <= 5 * len(x) and 100 * len(x & y) >= 80 * len(x | y):
                group[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def test_jaccard_groups(spark, odd, none, sf):
    assert sorted((tuple(r) for r in jaccard_join.jaccard_groups(odd).collect()), key=str) == shingle_groups(ODD)
    assert jaccard_join.jaccard_groups(none).count() == 0
    rows = list(texts(spark, sf).items())
    assert sorted((tuple(r) for r in queries.op5_jaccard_join(spark, sf).collect()), key=str) == shingle_groups(rows)


@pytest.mark.parametrize("block", [1000, 10])
def test_jaccard_of_a_large_group_of_near_copies(spark, block):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(90):
        own = base[: rng.choice([60, 90, 120])]
        for _ in range(rng.randint(0, 4)):
            own = [*own]
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.jaccard_groups(docs, block=block).collect()), key=str) == shingle_groups(rows)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, 0) + 0.05 * rng.standard_normal((30, 16)), base[:3]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (None, [0.0])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors, block=block).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    group = np.arange(len(x))
    for _ in range(len(x)):
        group = np.asarray([group[linked[k]].min() for k in range(len(x))])
    assert sum(got[k].n_links for k in range(len(x))) >= 0.97 * (linked.sum() - len(x))
    assert all(got[k].n_links <= linked[k].sum() - 1 and got[k].kept == (got[k].component_id == k) for k in range(len(x)))
    assert sum(got[k].component_id != group[k] for k in range(len(x))) <= 2
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad[:-1])
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_substring_dedup(spark, odd, none):
    passage = "Here are many words that come again. " * 2 + "They stand in more than one text, and end here, after a good many words. Short."
    rows = [(3, f"Own start of three.\n{passage}\nOwn end."), (1, f"First text. {passage}"), (2, f"{passage}"), (4, "Short. Nothing else."), (5, None)]
    docs = spark.createDataFrame([(i, t, 1.5, None) for i, t in rows], "doc_id long, text string, removed double, lang string")
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert out[4].text == "Short. Nothing else." and out[5].text == "" and out[2].text == ""
    assert out[3].text == "Own start of three.\nOwn end." and passage.split(". ")[1] in out[1].text
    for i, t in rows:
        at, kept = 0, ""
        for s in out[i].removed:
            kept, at = kept + t[at : s.start], s.end
        assert kept + (t or "")[at:] == out[i].text
    got = substring_dedup.remove_repeats(odd)
    assert got.count() == len(ODD) and got.columns == [c for c in odd.columns if c != "removed"] + ["removed"]
    assert {r.cell for r in got.collect()} == {"z"} and substring_dedup.remove_repeats(none).count() == 0


def single_pass(rows):
    """The cuts of each text by both rules, from dictionaries of all units and all windows in reading order."""
    words_of = lambda t: [(m.start(), m[0].lower()) for m in substring_dedup.WORDS.finditer(t)]
    size, units, windows, out = substring_dedup.WINDOW, set(), {}, {}
    for i, t in rows:
        ends, counts, digests = substring_dedup.units(t)
        again = []
        for n, d in zip(counts, digests, strict=True):
            again.append(n > 0 and d in units)
            units |= {d} if n else set()
        gone = [False] * len(t)
        for a, b in substring_dedup.removed_spans(ends, counts, again, substring_dedup.LEAST_WORDS):
            gone[a:b] = [True] * (b - a)
        words = words_of(t)
        places = [p for p, _ in words] + [len(t)]
        for k in range(len(words) - size + 1):
            key = tuple(w for _, w in words[k : k + size])
            where = windows.setdefault(key, (i, k))
            if where != (i, k):
                first = max(k, where[1] + size) if where[0] == i else k
                a, b = places[first], places[k + size]
                gone[a:b] = [True] * (b - a)
        out[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


def test_substring_dedup_equals_a_single_pass(spark, sf):
    rows = sorted(texts(spark, sf).items())
    want = single_pass(rows)
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, sf).collect()}
    for i, t in rows:
        kept, at = [], 0
        for span in got[i].removed:
            kept.append(t[at : span.start])
            at = span.end
        assert "".join([*kept, t[at:]]) == got[i].text == want[i]
        assert got[i].n_removed == len(got[i].removed)
    assert sum(bool(r.removed) for r in got.values()) > 5


def test_substring_dedup_finds_passages_inside_sentences(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    run, sentence = " ".join(word() for _ in range(50)), " ".join(word() for _ in range(60))
    wide = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(60))
    own = [" ".join(word() for _ in range(8)) for _ in range(12)]
    cases = [
        (1, f"{own[0]} {run} {own[1]}", f"{own[0]} {run} {own[1]}"),
        (2, f"{own[2]} {run.upper()} {own[3]}. End.", f"{own[2]} {own[3]}. End."),  # pasted into a sentence
        (3, f"{own[4]}, {sentence}, {own[5]}.", f"{own[4]}, {sentence}, {own[5]}."),
        (4, f"{own[6]}\n{sentence} {own[7]}", None),  # the last word lacks the comma
        (5, f"{own[8]}{wide}{own[9]}", f"{own[8]}{wide}{own[9]}"),
        (6, f"{own[10]}{wide}{own[11]}", f"{own[10]}{own[11]}"),  # no blanks
        (7, f"{own[0]} {' '.join(run.split()[:49])} x", None),  # 49 words in a row, and 8 more before them
        (8, " ".join(run.split()[1:]), " ".join(run.split()[1:])),  # 49 words stay
        (9, " ".join(["la"] * 180), " ".join(["la"] * 50) + " "),  # the earliest occurrence stays whole
    ]
    docs = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert {i: out[i].text for i, _, want in cases if want is not None} == {i: want for i, _, want in cases if want is not None}
    assert out[4].text == f"{own[6]}\n{sentence.split()[-1]} {own[7]}" and out[7].text == "x"
    assert all(t[s.start : s.end] for i, t, _ in cases for s in out[i].removed)


def test_no_run_of_fifty_words_is_left_twice(spark, sf):
    got, seen = {r.doc_id: r for r in queries.op1_substring_dedup(spark, sf).collect()}, {}
    for i, t in sorted(texts(spark, sf).items()):
        places = [(m.start(), m.end()) for m in substring_dedup.WORDS.finditer(t)]
        words, gone = [t[a:b].lower() for a, b in places], np.zeros(len(t), bool)
        for s in got[i].removed:
            gone[s.start : s.end] = True
        for k in range(len(words) - 49):
            e = seen.setdefault(tuple(words[k : k + 50]), (i, k))
            if e != (i, k):
                first = max(k, e[1] + 50) if e[0] == i else k
                assert gone[places[first][0] : places[k + 49][1]].all()


def test_html_text(spark, sf):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>Menu</nav><div class='cookie-notice'>N</div><article><h1>A &amp; B</h1><p>x\n y<br>z<p>second &eacute;<script>var t='</p>'</script></article><div id=comments>c</div><footer>F"
    rows = [(1, "http://a.example/x", page), (2, None, None), (None, "::", ""), (4, "http://b.example", "plain &lt;text&gt;"), (1, "http://a.example/x", page)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    assert [r[2] for r in got if r[0] == 1] == ["A & B\nx y z\nsecond é"] * 2 and {r[2] for r in got if r[0] in (2, None)} == {""}
    assert [r[2:] for r in got if r[0] == 4] == [("plain <text>", 12)] and html_text.extract(pages.limit(0)).count() == 0


def page_rows(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")


def prose(rng, words=20):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(words))


def test_a_host_is_judged_by_its_own_tree(spark):
    rng = random.Random(2)
    rows = [("http://large.example/", f"<body><div><p>The same words on all pages</div><article>{prose(rng)}</article>") for _ in range(60)]
    rows += [("http://small.example/", f"<body><div><p>{prose(rng)}</div>") for _ in range(12)]
    rows += [("http://few.example/", f"<body><div><p>The same words on all pages</div><article>{prose(rng)}</article>") for _ in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(page_rows(spark, rows)).collect()}
    assert all(got[k] == html.split("<p>")[1].removesuffix("</div>") for k, (url, html) in enumerate(rows) if "small" in url)
    assert all("same words" not in got[k] and got[k] for k, (url, _) in enumerate(rows) if "small" not in url)


def test_copies_of_pages_count_once(spark):
    rng = random.Random(4)
    html = [f"<body><div><p>Same everywhere</p></div><article><p>{prose(rng)}</p></article>" for _ in range(12)]
    rows = [("http://s.example/", h) for h in html for _ in range(20)] + [(f"http://mirror{k}.example/", html[0]) for k in range(40)]
    got = html_text.extract(page_rows(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.text == rows[r.page_id][1].split("<p>")[2].split("</p>")[0] for r in got)


def test_names_of_wrappers_remove_no_article():
    text, noise = "The article's own words, more than the rest.", "<div class='share'>Share</div>"
    for start, end in (
        ("<body class='has-sidebar comments-open'><p>", "</p></body>"), ("<main class='with-sidebar'><p>", "</p></main>"),
        ("<div id='page-header-wrap'><p>", "</p></div>"), ("<article class='post related-2'><p>", "</p></article>"),
        ("<div class=widget><section class=social><article><p>", "</p></article></section></div><p>" + "Other words. " * 20),
    ):
        assert html_text.main_text(f"{start}{text}{noise}{end}", frozenset()).split("\n")[0] == text
        assert "Share" not in html_text.main_text(f"{start}{text}{noise}{end}", frozenset())


def test_style_tree_finds_unnamed_noise(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    html = [f"<body><div class=x>Read more on our site</div><div class=y><p>{' '.join(word() for _ in range(20))}</p></div>" for _ in range(30)]
    pages = spark.createDataFrame([(k, "http://s.example/", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    out = [r.text for r in html_text.extract(pages).collect()]
    assert all(t and "Read more" not in t for t in out)
