"""String columns: tokenizers, n-grams, tag and spacing clean-up."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.split() treats as white space.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITESPACE_ASCII = r"[\t-\r\x1c-\x20]"
WHITESPACE_WIDE = (
    "\x85\xa0            "
    "    　"
)
WHITESPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " + WHITESPACE_WIDE
WORD = r"[\p{L}\p{N}_]{2,}"
WORD_ASCII = r"[a-z0-9_]{2,}"
REF_DELIMITER = "||<|>||"

# The published mteval-13a rules, applied in this order.
RULES_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES_13A = [("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(txt: Column) -> Column:
    return F.length(txt) == F.octet_length(txt)


def strip(txt: Column) -> Column:
    return F.btrim(txt, F.lit(WHITESPACE_CHARS))


def rstrip(txt: Column) -> Column:
    return F.rtrim(txt, F.lit(WHITESPACE_CHARS))


def is_blank(txt: Column) -> Column:
    return strip(txt) == ""


def clean_sentence(txt: Column) -> Column:
    return F.replace(strip(txt), F.lit("\n"), F.lit(""))


def ws_tokens(txt: Column) -> Column:
    """Split on runs of white space, no empty tokens.

    The class of all Unicode spaces is slow to match, so it is used only where one occurs.
    """
    wide = ~is_ascii(txt) & reduce(or_, [F.contains(txt, F.lit(c)) for c in WHITESPACE_WIDE])
    pieces = F.when(wide, F.split(txt, WHITESPACE + "+")).otherwise(
        F.split(txt, WHITESPACE_ASCII + "+")
    )
    return F.array_remove(pieces, "")


def space_tokens(txt: Column) -> Column:
    """Split on each single space; empty tokens are kept."""
    return F.split(txt, " ", -1)


def word_tokens(txt: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    low = F.lower(txt)
    return F.when(
        is_ascii(txt), F.regexp_extract_all(low, F.lit(WORD_ASCII), F.lit(0))
    ).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def windows(tokens: Column, n: int) -> Column:
    """Every run of ``n`` adjacent tokens, joined by a space; ``tokens`` is read many times."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + d) for d in range(n)])
        ),
    ).otherwise(F.array().cast("array<string>"))


def ngrams_range(tokens: Column, low: int = 1, high: int = 2) -> Column:
    return let(tokens, lambda a: F.concat(*[windows(a, n) for n in range(low, high + 1)]))


def metric_ngrams(tokens: Column, high: int = 4) -> Column:
    """``array<struct<n, gram>>`` of all n-grams up to ``high``."""

    def sized(grams: Column, n: int) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    return let(
        tokens, lambda a: F.concat(*[sized(windows(a, n), n) for n in range(1, high + 1)])
    )


def remove_tags(txt: Column, label: Column | str) -> Column:
    """Without the tags of a label, which may differ from row to row."""
    label = label if isinstance(label, Column) else F.lit(label)
    return F.regexp_replace(txt, F.concat(F.lit(r"\[\Q"), label, F.lit(r"\E[0-9]*\]")), F.lit(""))


def squeeze_spaces(txt: Column) -> Column:
    """One pass of two spaces to one, then at most one space off each end."""
    once = F.replace(txt, F.lit("  "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(once, r"\A ", ""), r" \z", "")


def swap_tags(txt: Column, source: str, target: str) -> Column:
    return F.replace(txt, F.lit(source), F.lit(target))


def append_eos(txt: Column) -> Column:
    return F.concat(txt, F.lit(" <eos>"))


def wrap_target(txt: Column) -> Column:
    return F.concat(F.lit("<sos> "), txt, F.lit(" <eos>"))


def strip_leading_quote(txt: Column) -> Column:
    return F.regexp_replace(txt, r'\A"', "")


def split_ref_list(txt: Column) -> Column:
    return F.transform(F.split(txt, rf"\Q{REF_DELIMITER}\E", -1), strip)


def clean_meteor_hyp(txt: Column) -> Column:
    return F.replace(F.replace(txt, F.lit("|||"), F.lit("")), F.lit("  "), F.lit(" "))


def tokenize_13a(txt: Column) -> Column:
    for old, new in ENTITIES_13A:
        txt = F.replace(txt, F.lit(old), F.lit(new))
    whole = F.replace(txt, F.lit("-\n"), F.lit(""))  # a word parted at a line's end
    txt = F.concat(F.lit(" "), F.replace(whole, F.lit("\n"), F.lit(" ")), F.lit(" "))
    for pattern, repl in RULES_13A:
        txt = F.regexp_replace(txt, pattern, repl)
    # bound to a name, as the tokens of an expression would follow all rules once more for every test of white space
    return F.array_join(let(txt, ws_tokens), " ")


