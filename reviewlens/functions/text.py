"""Column-level text functions.

All are built-in Spark expressions (JVM side, whole-stage codegen where Spark
supports it); no Python runs per row.  Regular expressions are written in the
subset shared by Java regex and RE2 so the DuckDB oracle can run the same text.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# English stop words (the standard NLTK English list, 179 words).
# ---------------------------------------------------------------------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# F1 accents: NFKD, then drop what is not ASCII.
# ---------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Built by rule from the Unicode database, over all code points: those whose NFKD form
    has one ASCII character (source and target string), and those with several."""
    single, several = {}, {}
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        base = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(base) == 1:
            single[ch] = base
        elif base:
            several[ch] = base
    return "".join(single), "".join(single.values()), several


def remove_accents(c: Column | str) -> Column:
    """characters fold to the ASCII part of their NFKD form, others outside ASCII go.
    ASCII texts pass through; texts with ligatures and the like are looked up by character."""
    c = _col(c)
    source, target, several = _accent_tables()
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())),
                         F.lit("\x01"), F.lit("\x02"))
    each = F.regexp_extract_all(c, F.lit("(?s)."), 0)
    wide = F.array_join(F.transform(each, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    some = F.translate(c, "".join(several), "") != c  # one pass; a class of so many characters is tried one by one
    folded = F.translate(F.when(some, wide).otherwise(c), source, target)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(folded, "[^\\x00-\\x7F]", "")).otherwise(c)


# ---------------------------------------------------------------------------
# F2 contractions: general endings, and the forms that don't follow them.
# ---------------------------------------------------------------------------
# Applied in this order to a lower-cased word.
ENDINGS = (("n't", " not"), ("'ve", " have"), ("'ll", " will"), ("'re", " are"), ("'m", " am"), ("'d", " would"))
# Forms that the endings don't give ('s is a possessive after other words).
IRREGULAR = {
    "ain't": "is not", "can't": "cannot", "shan't": "shall not", "sha'n't": "shall not", "won't": "will not",
    "let's": "let us", "so's": "so as", "ma'am": "madam", "o'clock": "of the clock", "how'd'y": "how do you",
    "y'all": "you all", "how'd": "how did", "where'd": "where did",
    "he's": "he is", "how's": "how is", "it's": "it is", "she's": "she is", "that's": "that is",
    "there's": "there is", "what's": "what is", "when's": "when is", "where's": "where is",
    "who's": "who is", "why's": "why is",
}
# A word with its inner apostrophes, or a run between words: quotes around a word stay outside.
CONTRACTION_PIECES = "[A-Za-z]+(?:'[A-Za-z]+)*|[^A-Za-z]+"
_BECAUSE = "(^|[^A-Za-z])'cause([^A-Za-z]|$)"
_STEM = "^(sha'n't|how'd'y|[a-z]+'[a-z]+)(.*)$"


def expand_contractions(c: Column | str) -> Column:
    """irregular words by table, others by their endings; what follows an irregular form
    ("can't've") is expanded by its ending too.  The first letter keeps its case ("CAN'T" ->
    "Cannot").  Matches are whole words, with or without quotes around them.
    """
    c = _col(c)
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])

    def endings(x: Column) -> Column:
        for old, new in ENDINGS:
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    def fix(t: Column) -> Column:
        low = F.lower(t)
        known = F.try_element_at(table, F.regexp_extract(low, _STEM, 1))
        full = F.coalesce(F.concat(known, endings(F.regexp_extract(low, _STEM, 2))), endings(low))
        upper = F.substring(t, 1, 1) != F.substring(low, 1, 1)
        cased = F.when(upper, F.concat(F.upper(F.substring(full, 1, 1)), F.substr(full, F.lit(2)))).otherwise(full)
        return F.when((F.instr(t, "'") > 0) & (full != low), cased).otherwise(t)

    plain = F.regexp_replace(c, "(?i)" + _BECAUSE, "$1because$2")
    pieces = F.regexp_extract_all(plain, F.lit(CONTRACTION_PIECES), 0)
    return F.when(F.instr(c, "'") > 0, F.array_join(F.transform(pieces, fix), "")).otherwise(c)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expand_contractions_sql(expr: str) -> str:
    """The same rules as DuckDB SQL (oracle)."""
    table = "MAP {" + ", ".join(f"{_sq(k)}: {_sq(v)}" for k, v in IRREGULAR.items()) + "}"
    quote = _sq("'")

    def endings(x: str) -> str:
        for old, new in ENDINGS:
            x = f"replace({x}, {_sq(old)}, {_sq(new)})"
        return x

    known = f"{table}[regexp_extract(lower(t), {_sq(_STEM)}, 1)]"
    rest = endings(f"regexp_extract(lower(t), {_sq(_STEM)}, 2)")
    full = f"coalesce({known} || {rest}, {endings('lower(t)')})"
    fix = (f"CASE WHEN NOT contains(t, {quote}) OR {full} = lower(t) THEN t WHEN left(t, 1) <> left(lower(t), 1) "
           f"THEN upper(left({full}, 1)) || substr({full}, 2) ELSE {full} END")
    plain = f"regexp_replace({expr}, {_sq('(?i)' + _BECAUSE)}, '\\1because\\2', 'g')"
    pieces = f"regexp_extract_all({plain}, {_sq(CONTRACTION_PIECES)})"
    return (f"CASE WHEN contains({expr}, {quote}) THEN "
            f"array_to_string(list_transform({pieces}, lambda t: {fix}), '') ELSE {expr} END")


# ---------------------------------------------------------------------------
# F3 dates, F4 tokenisers, F5 word tokens, F6 sentence split, F7 capitalise, F8 join
# ---------------------------------------------------------------------------
def standardize_date(c: Column | str) -> Column:
    """"M D, YYYY" -> "DD MM YYYY"; NULL when the text is not such a date."""
    ts = F.try_to_timestamp(_col(c), F.lit("M d, yyyy"))
    return F.date_format(ts, "dd MM yyyy")


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), "^\\s+|\\s+$", "")


def space_tokens(c: Column | str, lower: bool = False) -> Column:
    """Split the stripped text on single spaces, drop a final "." token."""
    s = strip_ws(c)
    if lower:
        s = F.lower(s)
    arr = F.split(s, " ")
    return F.when(F.element_at(arr, -1) == ".", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def whitespace_tokens(c: Column | str) -> Column:
    """Tokens separated by any whitespace run (no empty tokens)."""
    return F.filter(_pieces(c), lambda t: t != "")


def _pieces(c: Column | str) -> Column:
    """What stands between whitespace runs; empty at the ends of a text with outer whitespace, so it needs no strip."""
    return F.split(_col(c), "\\s+")


WORD_PATTERN = "[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]"


def word_tokens(c: Column | str, lower: bool = False) -> Column:
    """words and single punctuation marks as separate tokens."""
    s = _col(c)
    if lower:
        s = F.lower(s)
    return F.regexp_extract_all(s, F.lit(WORD_PATTERN), 0)


SENT_MARK = "\u0001"


def sentence_split(c: Column | str) -> Column:
    """Break after . ! ? followed by whitespace, and at line breaks; the
    punctuation stays with its sentence, empty pieces are dropped."""
    s = F.regexp_replace(_col(c), "([.!?])\\s+", "$1" + SENT_MARK)
    s = F.regexp_replace(s, "\\s*\\n\\s*", SENT_MARK)
    return F.filter(F.transform(F.split(s, SENT_MARK), strip_ws), lambda t: t != "")


def dot_split(c: Column | str) -> Column:
    """Pieces between '.' characters (empty pieces kept, not stripped)."""
    return F.split(_col(c), "\\.")


def capitalise(c: Column | str) -> Column:
    """first character upper, rest lower, then " ." -> "."."""
    c = _col(c)
    cap = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
    return F.replace(cap, F.lit(" ."), F.lit("."))


def join_sentences(arr: Column | str) -> Column:
    """F8: sentences joined with ". " and a final "."."""
    return F.concat(F.array_join(_col(arr), ". "), F.lit("."))


def token_set(c: Column | str) -> Column:
    """A19 + F9: distinct whitespace tokens that are not stop words, sorted."""
    # a list of literals beyond ten is a hash set, made once: one look for each token
    return F.array_sort(F.array_distinct(F.filter(_pieces(c), lambda t: (t != "") & ~t.isin(*STOP_WORDS))))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a & b| / |a | b|; +infinity when both sets are empty."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float("inf"))).otherwise(
        F.size(F.array_intersect(a, b)) / union)


def length_penalty(n: Column | str, min_len: float = 5, max_len: float = 20,
                   order: float = 1.5, lo: float = .4, hi: float = 1.0) -> Column:
    """lo + (1 - ((n - min)/(max - min))^order) * (hi - lo)."""
    frac = (_col(n).cast("double") - F.lit(min_len)) / F.lit(float(max_len - min_len))
    return F.lit(lo) + (F.lit(1.0) - F.pow(frac, F.lit(order))) * F.lit(hi - lo)
