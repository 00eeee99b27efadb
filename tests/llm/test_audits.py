"""Periodic runs, source divergence and license scans against brute force, on odd rows and on the smallest tables."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from styleops.llm import license_scan, periodic_runs, queries, source_divergence
from styleops.llm.common import table
from styleops.llm.suffix_tree import Extensions

ODD = [
    (1, "One two three."), (2, None), (3, ""), (4, " \n\t"), (None, "a b " * 9), (None, None), (1, "One two three."), (5, "x" * 9000),
    (6, "é 你好 🙂 " * 7), (7, "w\x00w a\x1cb c " * 8), (8, " ".join(f"w{k % 977}" for k in range(30_000))), (9, "same " * 40),
]
DOCS = "doc_id long, text string, lang string, source string, norm string, runs int, cells string, collapsed string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", "x", 1, "y", "z") for i, t in ODD], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_runs(words, least=12):
    """Every period, every stretch of words that equal the one a period on; a stretch with a smaller period is not new."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words])
    out = {}
    for q in range(1, len(w) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + q - a >= max(least, 2 * q):
                out.setdefault((a, b + q - a), q)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_extensions_equal_a_scan():
    rng = random.Random(3)
    for _ in range(40):
        text = [rng.randrange(2) + 1 for _ in range(rng.randrange(2, 90))] + [0]
        got = Extensions(text, 3)
        a, b = np.array([(a, b) for a in range(len(text)) for b in range(len(text)) if a != b]).T
        want = [next(k for k in range(len(text)) if text[x + k] != text[y + k]) for x, y in zip(a, b, strict=True)]
        assert got.of(a, b).tolist() == want


def test_runs_of_made_texts():
    rng = random.Random(7)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 8])
            text = [b"w%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
            texts.append(text)
        assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]
        assert periodic_runs.find_runs([np.array([int(w[1:]) for w in t], np.int64) for t in texts], 2) == [brute_runs(t, 2) for t in texts]


def contract_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (
        doc_id, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_op11_equals_brute_force(spark, sf, odd, none):
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    for docs in (table(spark, sf, "documents"), odd):
        rows = periodic_runs.summary(periodic_runs.periodic_runs(periodic_runs.with_planted_tails(docs))).collect()
        assert sorted((tuple(r) for r in rows), key=key) == sorted((contract_row(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert any(r[1] for r in rows)
    assert periodic_runs.periodic_runs(none).count() == 0
    assert queries.op11_periodic_runs(spark, sf).filter("n_runs > 0").count() > 10


def brute_divergence(rows, least, top):
    """All shares of all terms in all groups, straight from the definition."""
    docs = [(lang or "", source or "", source_divergence.terms_of((text or "").encode())) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in mine for t in set(terms))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for _, x, terms in mine if x == s for t in terms if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:limit]):
                    out.append((lang, s, part, item.decode(), value, k + 1))
    return sorted(out)


def test_divergence_equals_brute_force(spark, odd, none):
    rng = random.Random(11)
    words = [f"t{chr(97 + k)}{'é' if k % 3 else 'Z'}" for k in range(20)]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "É", "", None])
        rows.append((lang, source, rng.choice([None, "", "12 3", " ".join(rng.choices(words, k=rng.randrange(30))) + f" own{k}x"])))
    rows += [("en", "a", "Hot Copy tah"), ("en", "b", "Hot Copy tah")] * 60 + [("fr", "only", "few words"), ("fr", "two", "1")]
    docs = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, lang string, source string, text string").repartition(5)
    for least, top in ((30, 50), (10, 3)):
        got = sorted(tuple(r) for r in source_divergence.divergence(docs, least, top).collect())
        assert got == brute_divergence(rows, least, top)
    assert source_divergence.divergence(none).count() == 0
    assert source_divergence.divergence(odd).count() == 0


def test_divergence_hands_on_sums_in_parts(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").select("lang", "source", F.lower("text").alias("norm"))
    want = Counter()
    for r in docs.collect():
        for term, n in Counter(source_divergence.terms_of(r.norm.encode())).items():
            want[r.lang, r.source, term.decode()] += n
    sums, got = source_divergence.Sums(), Counter()
    for k, r in enumerate(docs.collect()):
        sums.add([(source_divergence.terms_of(r.norm.encode()), r.lang, [(r.source, 1)])])
        if k % 7 == 0:
            for batch in sums.out(rows=100):
                for x in batch.to_pylist():
                    got[x["lang"], x["source"], x["term"]] += x["n"]
    for batch in sums.out():
        for x in batch.to_pylist():
            got[x["lang"], x["source"], x["term"]] += x["n"]
    assert got == want


def edits_from_word_to_word(notice, text):
    """The fewest edits between the notice and any run of whole words of the text."""
    starts = [k for k in range(len(text)) if k == 0 or text[k - 1] == " "]
    ends = {k for k in range(1, len(text) + 1) if k == len(text) or text[k] == " "}
    best = len(notice)
    row = [0 if k in starts else 10**6 for k in range(len(text) + 1)]
    for c in notice:
        new = [row[0] + 1]
        for k in range(1, len(text) + 1):
            new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (text[k - 1] != c)))
        row = new
    return min([best, *(row[k] for k in ends)])


def noisy(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcxyz9é ")
        elif kind == 1:
            text.insert(at, rng.choice("abcxyz9é "))
        elif len(text) > 1:
            del text[at]
    return "".join(text)


def test_license_spans_equal_brute_force(spark):
    rng = random.Random(13)
    notices = sorted(license_scan.NOTICES)
    rows = []
    for k in range(160):
        filler = " ".join(rng.choice(["under", "the", "license", "mit", "über", "x1", "terms"]) for _ in range(rng.randrange(12)))
        notice = rng.choice(notices)
        text = noisy(rng, notice, rng.randrange(license_scan.edits_of(notice) + 3))
        rows.append((k, f"{filler}\n{text.title() if k % 2 else text}, {filler}."))
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = 0
    for k, text in rows:
        normal = b" ".join(license_scan.normal_words(text.encode())).decode()
        least = {}
        for s in found[k].spans:
            least[s.notice] = min(s.edits, least.get(s.notice, s.edits))
            words = " ".join(normal.split(" ")[s.first : s.first + s.words])
            assert edits_from_word_to_word(s.notice, words) <= s.edits <= license_scan.edits_of(s.notice)
        for notice in notices:
            need = edits_from_word_to_word(notice, normal)
            assert (notice in least) == (need <= license_scan.edits_of(notice)), (normal, notice, need)
            hits += notice in least
    assert hits > 60


def test_op13_base_equals_brute_force(spark, sf, odd, none):
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    made = [
        (1, "CC-BY, cc by; ccby CC  BY cc_by"), (2, "The MIT\nLicense and the Apache License"), (3, "Rélease mit licensé"), (4, "gnu general general public license"),
        (5, "GNU General Public License GNU General Public License"), (6, "Released under the MTI License"), (7, "Nothing here, licensed by nobody."), (None, "mit license"),
    ]
    made = spark.createDataFrame(made, "doc_id long, text string")
    for docs in (table(spark, sf, "documents").select("doc_id", "text"), made, odd.select("doc_id", "text")):
        got = license_scan.summary(license_scan.scan(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        want = []
        for r in docs.collect():
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
            words = ["".join(g) for ok, g in groupby(lower, lambda c: c in "0123456789" or "a" <= c <= "z" or c > "\x7f") if ok]
            places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
            at = [k for k, _ in places]
            want.append((r.doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    rows = {r.doc_id: r for r in license_scan.summary(license_scan.scan(made)).collect()}
    assert rows[6].labels == "mit" and rows[6].n_base == 0 and 0.9 < rows[6].score < 1 and rows[7].labels == "" and rows[7].score == 0
    assert license_scan.scan(none).count() == 0
    assert queries.op13_license_scan(spark, sf).count() == table(spark, sf, "documents").count()
