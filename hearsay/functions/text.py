"""Text composition, normalisation and tokenising as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and masks of the text normaliser.
HTML_MARK = "{html}"
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s]"
URL_RUN = r"(?U)http\S+"
URL_MASK = "[URL]"
DIGIT_RUN = "[0-9]+"
NUM_MASK = "[NUM]"


def compose(title: Column, body: Column, null_policy: str = "skip") -> Column:
    """``title + ' ' + body``.

    ``skip`` leaves a missing part out; ``propagate`` makes the whole text
    missing and then spells it ``nan``, as string coercion does.
    """
    if null_policy == "skip":
        return F.concat_ws(" ", title, body)
    if null_policy == "propagate":
        return F.coalesce(F.concat(title, F.lit(" "), body), F.lit("nan"))
    raise ValueError(f"unknown null_policy {null_policy!r}")


def normalize(text: Column) -> Column:
    """Lower-case, drop the html mark and punctuation, then mask URLs and numbers.

    Punctuation goes first, so ``https://a.b/c`` is already ``httpsabc`` when it
    is masked; the order is observable and kept.
    """
    text = F.replace(F.lower(text.cast("string")), F.lit(HTML_MARK), F.lit(""))
    text = F.regexp_replace(text, PUNCTUATION, "")
    text = F.regexp_replace(text, URL_RUN, URL_MASK)
    return F.regexp_replace(text, DIGIT_RUN, NUM_MASK)


def repair_masks(text: Column) -> Column:
    """``[ NUM ]`` -> ``[NUM]``."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\s", "["), r"\s\]", "]")


def tokens(text: Column) -> Column:
    """Whitespace tokens; null or blank text gives an empty array."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+")
    return F.filter(parts, lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def char_count(text: Column) -> Column:
    return F.length(text)


def prefix(text: Column, n: int = 500) -> Column:
    """Fixed-length prefix (an input option of one scorer, not of the pipeline)."""
    return F.substring(text, 1, n)


def remove_stop_words(token_array: Column, stop_words: Sequence[str]) -> Column:
    """Drop tokens found in a stop list, ignoring case."""
    stops = sorted({w.lower() for w in stop_words})
    if not stops:
        return token_array
    return F.filter(token_array, lambda t: ~F.lower(t).isin(stops))


def letter_tokens(text: Column) -> Column:
    """Whitespace tokens with all non-letters stripped; empty ones are dropped.

    Stripping the whole text first gives the same tokens in one pass.
    """
    return tokens(F.regexp_replace(text.cast("string"), r"(?U)[^\p{L}\s]", ""))


def map_lemmas(token_array: Column, lexicon: Mapping[str, str]) -> Column:
    """Replace tokens by lemmas of a small in-memory lexicon."""
    if not lexicon:
        return token_array
    table = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    return F.transform(token_array, lambda t: F.coalesce(table[t], t))


def lemmatize(df: DataFrame, id_col: str, token_col: str, lexicon: DataFrame,
              out_col: str = "lemmas") -> DataFrame:
    """Replace tokens through a lexicon table ``(word, lemma)`` of any size.

    Spark broadcasts a lexicon it knows to be small, so a text is put together
    before the only shuffle; a larger one is joined by word.
    """
    words = df.select(id_col, F.posexplode_outer(token_col).alias("_pos", "word"))
    cell = F.when(F.col("word").isNotNull(), F.struct(
        "_pos", F.coalesce("lemma", "word").alias("w")))
    joined = (words.join(lexicon.select("word", "lemma"), "word", "left").groupBy(id_col)
              .agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["w"]).alias(out_col)))
    others = [c for c in df.columns if c != id_col]
    return df.join(joined, id_col) if others else joined
