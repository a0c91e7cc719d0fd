"""Text rules as native column expressions (no Python UDF anywhere).

Every function takes and returns ``Column`` objects, so the rules run inside whole-stage codegen or
Spark's higher-order functions on the executors. The regular expressions are written so that Java's
engine and RE2 (used by the DuckDB oracles) read them the same way, and so that both agree with
Python's ``re`` on the points where the reference relied on Python semantics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.stopwords import FRENCH_STOPWORDS

# The characters Python's str.strip() / str.split() treat as whitespace, as a regex
# character-class body. Java's and RE2's own \s miss some of them (\x1c-\x1f, \x85, \xa0, ...).
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Word characters (Python's Unicode \w without the handful of newest letters).
WORD = r"\p{L}\p{N}_"
# The HTML rule - any tag on one line (Python's '.' stops only at \n), or a named,
# decimal or hex entity closed by ';'. Entities are deleted, not decoded.
HTML_TAG_OR_ENTITY = r"<[^\n]*?>|&([a-zA-Z0-9]+|#[0-9]{1,6}|#x[0-9a-fA-F]{1,6});"
# The highlight markers of a search snippet.
START_SEL, STOP_SEL = "<b>", "</b>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: trims every Unicode whitespace character, not only U+0020."""
    return F.regexp_replace(_c(col), f"^[{WS}]+|[{WS}]+$", "")


def split_ws(col: Column | str) -> Column:
    """Python ``str.split()``: words separated by runs of whitespace, no empty words."""
    return F.filter(F.split(_c(col), f"[{WS}]+"), lambda w: w != "")


def html_clean(col: Column | str) -> Column:
    """Delete tags and entities, turn tab/CR/LF into spaces, collapse spaces, trim; null -> ''."""
    text = F.regexp_replace(_c(col), HTML_TAG_OR_ENTITY, "")
    text = F.translate(text, "\n\r\t", "   ")
    text = F.regexp_replace(text, " +", " ")
    return F.coalesce(trim_ws(text), F.lit(""))


def first_line(col: Column | str) -> Column:
    return F.substring_index(_c(col), "\n", 1)


def tokens(col: Column | str, keep_symbols: bool = False) -> Column:
    """Lexemes of the *simple* text configuration: lower-cased runs of word characters, in order. With
    ``keep_symbols`` the signs ``+`` and ``#`` behind a word belong to it (``c++``, ``c#``)."""
    pattern = f"[{WORD}]+[+#]*" if keep_symbols else f"[{WORD}]+"
    return F.coalesce(F.regexp_extract_all(F.lower(_c(col)), F.lit(pattern), 0), F.array().cast("array<string>"))


def fts_terms(col: Column | str, stopwords: Iterable[str] = FRENCH_STOPWORDS) -> Column:
    """Clean a CV for text search and return its words in order.

    Letter-spaced text ("P y t h o n", mean word length < 1.5) is first re-joined: two or more spaces
    separate words, single spaces are removed. Otherwise whitespace runs become one space. Then
    everything but word characters, whitespace, '+', '#' and '-' becomes a space, and stop words and
    one-character words are dropped.
    """
    text = trim_ws(F.coalesce(_c(col), F.lit("")))
    words = split_ws(text)
    letters = F.length(F.regexp_replace(text, f"[{WS}]", ""))
    mean_len = letters / F.greatest(F.size(words), F.lit(1))
    spaced = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.lower(text), "  +", "\n"), " ", ""), "\n", " "
    )
    normal = F.lower(F.regexp_replace(text, f"[{WS}]+", " "))
    text = F.when(mean_len < 1.5, spaced).otherwise(normal)
    text = F.regexp_replace(text, f"[^{WORD}{WS}+#\\-]", " ")
    stop = list(dict.fromkeys(stopwords))
    # ``isin`` over literals becomes a hash-set lookup (InSet), so a long CV costs O(words).
    if stop:
        return F.filter(split_ws(text), lambda w: (F.length(w) > 1) & ~w.isin(stop))
    return F.filter(split_ws(text), lambda w: F.length(w) > 1)


def fts_clean(col: Column | str, stopwords: Iterable[str] = FRENCH_STOPWORDS) -> Column:
    """The cleaned CV text (words joined by one space)."""
    return F.array_join(fts_terms(col, stopwords), " ")


def query_lexemes(cleaned_terms: Column, keep_symbols: bool = False) -> Column:
    """Distinct query lexemes of a cleaned term list, every term kept."""
    return F.array_distinct(F.flatten(F.transform(cleaned_terms, lambda t: tokens(t, keep_symbols))))


def headline_keywords(col: Column | str, limit: int = 10) -> Column:
    """Keywords of a highlighted snippet: text inside <b>...</b>, trimmed, lower-cased, punctuation
    removed, words longer than two letters, distinct in order of appearance, first ``limit``."""
    marked = F.regexp_extract_all(_c(col), F.lit(r"<b>([^<]+)</b>"), 1)

    def clean(term: Column) -> Column:
        stripped = F.regexp_replace(F.lower(trim_ws(term)), f"[^{WORD}{WS}]", "")
        return F.array_join(F.filter(split_ws(stripped), lambda w: F.length(w) > 2), " ")

    kept = F.filter(F.transform(marked, clean), lambda t: t != "")
    return F.coalesce(F.slice(F.array_distinct(kept), 1, limit), F.array().cast("array<string>"))


def nested_text(col: Column | str, field: str) -> Column:
    """Text of the ``field`` of every element of an array of structs (or of one struct), joined by a
    space; null and empty values are skipped; a null input gives ''."""
    c = _c(col)
    values = F.transform(c, lambda x: x[field])
    return F.coalesce(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), " "), F.lit(""))


def nested_text_of_struct(col: Column | str, field: str) -> Column:
    value = _c(col)[field]
    return F.coalesce(value, F.lit(""))


def nested_text_from_json(col: Column | str, field: str) -> Column:
    """Tolerant flavour for text input: a JSON list of objects or plain values, a JSON object, or any other
    text, which stays as it is (also if it only looks like JSON)."""
    c = _c(col)
    path = f"$['{field}']"
    valid = F.get_json_object(c, "$").isNotNull()
    # as text, an element of a list is its own JSON: an object gives its field, a plain value itself
    values = F.transform(F.from_json(c, "array<string>"),
                         lambda x: F.when(F.startswith(x, F.lit("{")) & F.get_json_object(x, "$").isNotNull(),
                                          F.get_json_object(x, path)).otherwise(x))
    from_list = F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), " ")
    looks_list = F.startswith(F.ltrim(c), F.lit("["))
    looks_obj = F.startswith(F.ltrim(c), F.lit("{"))
    return F.coalesce(
        F.when(looks_list & valid, F.coalesce(from_list, c))
        .when(looks_obj & valid, F.coalesce(F.get_json_object(c, path), F.lit(""))).otherwise(c),
        F.lit(""),
    )


def vector_text(title, description, competences, formations, qualities) -> Column:
    """Embedding input: title, description and the three nested texts joined by one space, each part
    coalesced to '' first (so an empty part still leaves its separator, as both reference flavours do
    for typed input)."""
    parts = [F.coalesce(_c(p), F.lit("")) for p in (title, description, competences, formations, qualities)]
    return F.concat_ws(" ", *parts)


def search_text(title, description, competences, qualities, quality_descriptions) -> Column:
    """The text that snippets and keywords are taken from: title, description, skill names, quality names and quality
    descriptions, joined by a space; null and empty parts are left out."""
    parts = [F.nullif(_c(p), F.lit("")) for p in (title, description, competences, qualities, quality_descriptions)]
    return F.concat_ws(" ", *parts)


def linear_map(value, from_min, from_max, to_min, to_max) -> Column:
    """Map ``value`` linearly from [from_min, from_max] to [to_min, to_max]; a zero-width source
    range maps to ``to_min``."""
    v, a, b, c, d = (F.lit(x) if not isinstance(x, (Column, str)) else _c(x) for x in (value, from_min, from_max, to_min, to_max))
    return F.when(b - a == 0, c.cast("double")).otherwise(c + (d - c) * (v - a) / (b - a))


def offer_url(job_id: Column | str, base: str) -> Column:
    return F.concat(F.lit(base), _c(job_id).cast("string"))


def display_date(col: Column | str) -> Column:
    """ISO timestamp text (trailing 'Z' or offset allowed) -> its own 'yyyy-MM-dd'; unparsable or missing -> 'N/A'."""
    cleaned = F.regexp_replace(F.replace(_c(col), F.lit("Z"), F.lit("")), r"(:\d{2}(?:\.\d+)?)[+-]\d{2}:?\d{2}$", "$1")
    parsed = F.coalesce(
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd'T'HH:mm")),
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd")),
    )
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit("N/A"))


def percent(col: Column | str) -> Column:
    """Similarity in [0, 1] -> whole percent, truncated toward zero."""
    return (_c(col) * 100).cast("int")
