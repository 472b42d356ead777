"""Text functions as Column expressions: folding, tokens, shingles, sections, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Apostrophes that fold to one, and the words that ranking leaves out.
APOSTROPHES = "‘’‚‛ʼ`´′＇"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this",
    "to", "was", "were", "will", "with", "what", "which", "who", "whom", "does", "do", "did", "how", "when", "where", "under", "any",
)
TOKEN = "[a-z0-9]+(?:'[a-z]+)?"
HEADING_WEIGHT = 3


def folded(text: Column) -> Column:
    """Lower case with apostrophes, ß and common ligatures folded."""
    out = F.lower(F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES)))
    for a, b in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words(text: Column) -> Column:
    """All words as ranking reads them: folded, without a possessive 's."""
    return F.transform(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)), lambda w: F.regexp_replace(w, "'s$", ""))


def tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(words_column: str, size: int = 5) -> Column:
    """Distinct word n-grams of a column of words; a shorter text is one, an empty one none.

    The words must be a column of the row: an expression inside the loop would be evaluated for every n-gram.
    """
    w = F.col(words_column)
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.concat_ws(" ", w))).otherwise(F.array_distinct(grams))


def shingle_hashes(words_column: str, size: int = 5) -> Column:
    """shingles() as 64-bit hashes, of a column of the words' own hashes: no n-gram is ever put together as text."""
    w = F.col(words_column)
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(w))).otherwise(F.array_distinct(grams))


def sections(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, text: the lines of each document that are not blank, in order."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).where(F.col("text").rlike("[^\\s]"))
    return lines.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).select("doc_id", "ordinal", "text")


def length_prefixed(kind: str, *parts: Column) -> Column:
    """SHA-256 identity of a tuple: parts with their byte lengths, NULL apart from the empty text."""
    encoded = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *encoded).cast("binary"), 256)


SQL_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
SQL_FOLD = "replace(replace(replace(replace(lower(translate({x}, '" + APOSTROPHES + "', '" + "''" * len(APOSTROPHES) + "')), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
SQL_WORDS = "list_transform(regexp_extract_all(" + SQL_FOLD + ", '[a-z0-9]+(?:''[a-z]+)?'), lambda w: regexp_replace(w, '''s$', ''))"
SQL_TOKENS = "list_filter(" + SQL_WORDS + ", lambda w: w NOT IN (" + SQL_STOP + "))"
SQL_SECTIONS = (
    "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), "
    "sections AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS ordinal, text FROM lines WHERE regexp_matches(text, '[^\\s]'))"
)
SQL_SHINGLES = (
    "CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN [array_to_string({w}, ' ')] ELSE list_distinct([array_to_string({w}[i:i+4], ' ') FOR i IN range(1, len({w}) - 3)]) END"
)
