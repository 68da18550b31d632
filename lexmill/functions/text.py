"""Text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the token pattern of the simple tokenizer.
TOKEN = "([가-힣]+|[a-z0-9]+)"
#: Article references, and citations with a quoted name.
ARTICLE_REF = r"제\d+조(?:의\d+)?"
FULL_REF = r"제\d+조(?:의\d+)?(?:\s*제\d+항)?(?:\s*제\d+호)?"
CITATION = r"「([^」]+)」\s*(제\d+조(?:의\d+)?)"


def tokens(text: Column | str) -> Column:
    """Lower-cased Hangul, Latin and digit runs, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


#: Signs whose upper case in full takes several signs, and the one sign that each becomes alone: itself where there is none.
_LONG = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
_ALONE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG]


def upper(text: Column | str) -> Column:
    """Upper case sign by sign, as SQL engines have it: no sign becomes several, and ß becomes ẞ."""
    text = F.col(text) if isinstance(text, str) else text
    signs = "".join(_LONG)
    runs = F.regexp_extract_all(text, F.lit(f"[{signs}]+|[^{signs}]+"), F.lit(0))
    one_by_one = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{signs}]"), F.translate(r, signs, "".join(_ALONE))).otherwise(F.upper(r))), "")
    return F.when(F.octet_length(text) == F.length(text), F.upper(text)).otherwise(one_by_one)


def keyword_tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Tokens of two characters or more that are no stop word."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(*stopwords) if stopwords else F.length(t) >= 2)


def token_count(text: Column) -> Column:
    """Estimated model tokens: 0 for no text, otherwise a token for 2.5 characters, one at least."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 2.5))).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two token arrays as sets: 1 for two empty ones, 0 for one empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(ratio(both, either))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common tokens over the smaller of both sets; 0 if one is empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def article_references(text: Column) -> Column:
    """Distinct article references without white space, in the order of their first occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ARTICLE_REF), F.lit(0)), no_space))


def remove_article_references(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ARTICLE_REF, ""))


def sort_number(display: Column) -> Column:
    """struct<main, sub>: numbers of an article label, a circled digit, a Hangul letter or a plain number."""
    circled = F.ascii(F.substring(display, 1, 1)) - F.lit(0x2460) + 1
    letters = "가나다라마바사아자차카타파하"
    letter = F.instr(F.lit(letters), F.substring(display, 1, 1))
    article = F.regexp_extract(display, r"제(\d+)", 1)
    plain = F.regexp_extract(display, r"^\s*(\d+)", 1)
    main = (
        F.when(article != "", article.cast("int"))
        .when(circled.between(1, 20), circled)
        .when(plain != "", plain.cast("int"))
        .when((F.length(display) > 0) & (letter > 0), letter)
    )
    sub = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(display, r"의\s*(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    return F.struct(main.cast("int").alias("main"), sub.alias("sub"))


def redact(text: Column) -> Column:
    """Mail addresses, card-like numbers, phone numbers and resident numbers replaced by a tag."""
    for pattern, tag in REDACTIONS:
        text = F.regexp_replace(text, pattern, tag)
    return text


#: Redaction patterns, applied in this order.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}\b", "[CARD]"),
    (r"\b\d{6}-\d{7}\b", "[ID]"),
    (r"\b\d{2,3}-\d{3,4}-\d{4}\b", "[PHONE]"),
)
#: Patterns of attacks on a query box.
ATTACKS = {
    "sql": r"(?i)(union\s+select|drop\s+table|insert\s+into|or\s+1\s*=\s*1)",
    "script": r"(?i)(<script|javascript:|onerror\s*=)",
    "path": r"(\.\./|\.\.\\)",
    "command": r"(;\s*(rm|cat|ls|wget|curl)\s|\|\s*(sh|bash)|\$\()",
    "prompt": r"(?i)(ignore (all )?previous instructions|system prompt)",
}


def attack_flags(text: Column) -> Column:
    """Names of the attack classes that a text matches."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in ATTACKS.items())))


def latin_share(text: Column) -> Column:
    """Latin letters over Latin and Hangul letters; 0 without either."""
    latin = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÖØ-öø-ÿ]", ""))
    hangul = F.length(F.regexp_replace(text, "[^가-힣]", ""))
    return ratio(latin, latin + hangul)


def ascii_share(text: Column) -> Column:
    """ASCII characters over all characters; 0 for an empty text."""
    return ratio(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.length(text))


def collapse_private_use(text: Column) -> Column:
    """Private-use signs of word processors: two bullets and a check mark are replaced, the others go."""
    text = F.translate(text, "\uf85e\uf09e\uf0fc", "\u00b7\u00b7\u2713")
    return F.regexp_replace(text, "[\ue000-\uf8ff]+", "")


def unwrapped_citation(text: Column) -> Column:
    """array of "name article" for each citation with a quoted name."""
    names = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    articles = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), articles.alias("a")), lambda z: F.concat_ws(" ", z["n"], no_space(z["a"])))
