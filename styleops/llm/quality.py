"""Quality classifier: a sparse ensemble of rules read from small trees, compiled to column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.llm.common import as_row, content_digest, narrow, row_columns, small_batches, whole_text, written

#: The fit takes at most this many labelled rows, those with the smallest hash of the id.
TRAINING_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002
#: Statistics of a text, in the order in which they are computed.
STATISTICS = [
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_neighbours", "letters", "upper", "digits",
    "symbols", "marks", "upper_words", "symbol_ends", "lines", "distinct_lines", "short_lines", "stops",
]
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS, _MARKS = b"#&%$*|<>{}[]\\^~_=+@/", b"!?;:"
_STOPS = b".,!?;:"


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one whole text; those of an empty text are zeros."""
    data = text.encode("utf-8", "replace")
    n, words = len(data), data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    w, counts, lines = len(words), Counter(words), [x for x in data.split(b"\n") if x.strip()]
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    upper, lower = share(_UPPER), share(_LOWER)
    ends = sum(x[-1] in _SYMBOLS for x in counts.elements()) if len(counts) < 50 else sum(c for x, c in counts.items() if x[-1] in _SYMBOLS)
    import math

    return (
        math.log(n + 1), math.log(w + 1), n / w, float(max(map(len, counts))), len(counts) / w, counts.most_common(1)[0][1] / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, upper + lower, upper, share(_DIGITS), share(_SYMBOLS), share(_MARKS),
        sum(c for x, c in counts.items() if x.isupper()) / w, ends / w, len(lines) / w, len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines), share(_STOPS),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, content`` (the text's digest) and the statistics of each whole text (null as empty), one row for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = pd.DataFrame([statistics(t) for t in rows["norm"]], columns=STATISTICS)
            yield pd.concat([rows[["doc_id"]].astype("Int64"), rows[["content"]], made], axis=1)

    fields = ", ".join(f"{s} double" for s in STATISTICS)
    base = docs.select(F.col("doc_id").cast("long"), content_digest().alias("content"), whole_text().alias("norm"))
    return base.mapInPandas(run, f"doc_id long, content binary, {fields}")


@dataclass(frozen=True)
class Condition:
    """``column <= bound`` if ``below``, else ``column > bound``."""

    column: str
    below: bool
    bound: float

    def column_expression(self) -> Column:
        return F.col(self.column) <= self.bound if self.below else F.col(self.column) > self.bound


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """An intercept and the weight of each rule; a row's score is the logistic of the weights of its rules."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = rule[0].column_expression()
    for condition in rule[1:]:
        out = out & condition.column_expression()
    return out


_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(description: str, columns: Sequence[str]) -> list[Rule]:
    """Every path from the root to a node of a printed tree or forest, as a conjunction without repeats."""
    path: list[tuple[int, Condition]] = []
    rules: dict[Rule, None] = {}
    for line in description.splitlines():
        if not (m := _NODE.match(line)):
            if "Tree" in line:
                path = []
            continue
        while path and path[-1][0] >= len(m[1]):
            path.pop()
        path.append((len(m[1]), Condition(columns[int(m[3])], m[4] == "<=", float(m[5]))))
        rules[_tightest(c for _, c in path)] = None
    return list(rules)


def _tightest(conditions) -> Rule:
    """One bound for each column and direction."""
    best: dict[tuple[str, bool], float] = {}
    for c in conditions:
        key = (c.column, c.below)
        best[key] = c.bound if key not in best else (min if c.below else max)(best[key], c.bound)
    return tuple(Condition(col, below, bound) for (col, below), bound in sorted(best.items()))


def fit(rows: DataFrame, label: str = "label", limit: int = TRAINING_ROWS) -> RuleEnsemble:
    """Rules from the trees of a small random forest over the statistics, weighted by a lasso logistic fit.

    At most ``limit`` rows are taken, by the smallest hash of ``doc_id``. With no row, or with one
    class only, the score is constant (0.5 without rows).
    """
    sample = written(narrow(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col(label).cast("double").alias("label"), *STATISTICS)), "training")
    found = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return RuleEnsemble(0.0 if not found else (20.0 if 1.0 in found else -20.0), {})
    vectors = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.4", minInstancesPerNode=5, seed=7).fit(vectors)
    rules = tree_rules(forest.toDebugString, STATISTICS)
    if not rules:
        share = found.get(1.0, 0) / sum(found.values())
        return RuleEnsemble(20.0 * (2 * share - 1), {})
    flags = F.array(*[F.when(holds(r), 1.0).otherwise(0.0) for r in rules])
    hits = written(narrow(sample.select("label", flags.alias("flags"))), "rule-hits")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    model = lasso.fit(hits.select("label", array_to_vector("flags").alias("features")))
    weights = {r: w for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if w != 0}
    return RuleEnsemble(float(model.intercept), weights)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: CRC-32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, content, score`` of every row."""
    stats = written(with_statistics(docs), "statistics")
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    # of rows that repeat an id, the one with the smallest digest is learnt from, whatever order they come in
    labelled = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("content", "label", *STATISTICS)).alias("row"))
    model = fit(labelled.select("doc_id", "row.label", *[F.col(f"row.{c}") for c in STATISTICS]))
    return stats.select("doc_id", "content", model.score().alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; 1 is good.

    Labels come from ``labels.quality`` (0 or 1; null labels and ids are left out, repeated ones count
    once, an id with both labels with its larger one) of rows that are not held out; of rows that repeat an id the one with the
    smallest digest of its text is learnt from. A score depends on the text only, a null text counts as empty; an empty table gives an empty
    result; other columns are not read.
    """
    return _scored(docs, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with all their columns.

    Each row is judged by its own text, whatever its id: rows with null or repeated ids too.
    """
    good = _scored(docs, labels).filter("score >= 0.5").select(F.col("content").alias("good")).distinct()
    rows = docs.select(as_row(docs).alias("row"), content_digest().alias("content"))
    return rows.join(good, F.col("content") == F.col("good"), "left_semi").select(*row_columns(docs, "row"))
