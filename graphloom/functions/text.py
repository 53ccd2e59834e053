"""Text functions as Column expressions; Python only where no expression says the same."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import words as W
from ..operators.rules import strip

_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def collapse_whitespace(text: Column) -> Column:
    """One blank for each run of white space within a line; no blank lines."""
    lines = F.transform(F.split(text, _BREAKS), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, r"<[^>]+>", " ")


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def strip_html(markup: Column) -> Column:
    """Text of markup; entities are only looked for where there is an ampersand."""
    plain = strip_tags(markup)
    return F.when(plain.contains("&"), unescape_entities(plain)).otherwise(plain)


def normalize_entity(text: Column, longest: int = 100) -> Column:
    """Without quotes and brackets around it, on one line, case kept, cut to length."""
    x = strip(text)
    x = F.regexp_replace(F.regexp_replace(x, r"""^["'`()\[\]]+""", ""), r"""["'`()\[\]]+\z""", "")
    return F.substring(F.regexp_replace(F.replace(x, F.lit("\n"), F.lit(" ")), r"(?U)\s+", " "), 1, longest)


def normalize_predicate(text: Column) -> Column:
    x = F.translate(strip(text), "_-", "  ")
    return F.lower(F.regexp_replace(x, r"(?U)\s+", " "))


def json_block(text: Column) -> Column:
    """JSON of a model's answer: what a fence encloses, else from the first { to the last }, else the text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare).otherwise(strip(text))


def tokens(text: Column, stop: tuple[str, ...] = W.QUERY_STOPWORDS) -> Column:
    """Distinct words of a question: lower-case letters, three or more, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*stop)))


def label_relevance(label: Column, query: Column) -> Column:
    """Share of common words; else 0.4 if a query word is inside a label word, 0.3 the other way round, else 0."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("[a-z]+"), F.lit(0)))
    common = F.size(F.array_intersect(words, query))
    inside = lambda a, b: F.exists(a, lambda x: (F.length(x) >= 4) & F.exists(b, lambda y: y.contains(x)))
    return (
        F.when((F.size(words) == 0) | (F.size(query) == 0), 0.0)
        .when(common > 0, common / F.least(F.size(words), F.size(query)))
        .when(inside(query, words), 0.4)
        .when(inside(words, query), 0.3)
        .otherwise(0.0)
    )


def mention_score(relevance: Column, label: Column, degree: Column) -> Column:
    """Relevance, less for phrases of two words (0.1) and more (0.4), more for degree (at most 0.3)."""
    n = F.size(F.filter(F.split(label, r"(?U)\s+"), lambda x: x != ""))
    return F.bround(relevance - F.when(n >= 3, 0.4).when(n == 2, 0.1).otherwise(0.0) + F.least(degree / 20.0, F.lit(0.3)), 3)


def neighbour_score(weight: Column, shared: Column, in_scope: Column) -> Column:
    return 0.2 * F.least(weight / 10.0, F.lit(1.0)) + 0.3 * F.least(shared / 5.0, F.lit(1.0)) + F.when(in_scope, 0.3).otherwise(0.0)


def traversal_score(common: Column, n_query: Column, in_target: Column, weight: Column, predicate_weight: Column, depth: Column) -> Column:
    """Priority of a node in a best-first walk; -1 marks a blocked predicate."""
    relevance = F.when(common > 0, 0.4 * common / F.greatest(n_query, F.lit(1))).otherwise(0.0)
    edge = F.when(weight > 0, 0.2 * F.least(weight / 10.0, F.lit(1.0)) * predicate_weight).otherwise(0.0)
    return F.when((weight > 0) & (predicate_weight == 0), -1.0).otherwise(relevance + F.when(in_target, 0.3).otherwise(0.0) + edge - 0.05 * depth)


def clean_text(raw: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """One kind of line end, no tabs, page numbers, or lines in which a boilerplate pattern is found; blanks collapsed."""
    x = F.regexp_replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\t+", " ")
    keep = F.filter(F.transform(F.split(x, "\n"), strip), lambda y: ~y.rlike(r"(?i)^(?:page\s+)?\d+\z"))
    if boilerplate:
        found = "(?i)" + "|".join(f"(?:{p})" for p in boilerplate)
        keep = F.filter(keep, lambda y: ~y.rlike(found))
    text = F.regexp_replace(F.array_join(keep, "\n"), " {2,}", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: strip(x) != "")


def overlapping_windows(text: Column, most: int, overlap: int) -> Column:
    """A long text as windows of `most` characters that share `overlap`; a short one as it is."""
    if overlap >= most:
        raise ValueError("overlap must be smaller than the window")
    n, step = F.length(text), most - overlap
    last = F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("int")
    return F.when(n <= most, F.array(text)).otherwise(F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, F.lit(most)))), lambda x: x != ""))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def canonical_predicate(p: Column) -> Column:
    """The canonical form of a predicate's group, or null."""
    table = F.create_map(*(F.lit(x) for canon, variants in W.SYNONYMS.items() for w in (canon, *variants) for x in (w, canon)))
    return F.try_element_at(table, strip(F.lower(p)))


_PASSIVE = r"^(?:is|was|are|were|be|been|being) .*"


def stem(word: Column) -> Column:
    """A rough English stem that stands in for a lemma."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, r"(?:ing|ed|es|s|d|e)\z", "")).otherwise(word)


def core_tokens(p: Column) -> Column:
    """Stems of a predicate's words without forms of to be and the prepositions of voice."""
    found = F.regexp_extract_all(F.lower(p), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: ~x.isin("is", "are", "was", "were", "be", "been", "being", "by", "of", "from")), stem)))


def is_inverse_pair(a: Column, b: Column) -> Column:
    """One passive with `by`, the other not, over the same core words."""
    passive = lambda x: strip(F.lower(x)).rlike(_PASSIVE) & F.lower(x).contains(" by")
    return (passive(a) != passive(b)) & (F.size(core_tokens(a)) > 0) & (core_tokens(a) == core_tokens(b))


def verb_preposition(p: Column) -> Column:
    """(stem, role preposition) where the last preposition follows another word, or null."""
    w = F.split(strip(F.lower(p)), r"\s+")
    at = F.array_max(F.transform(w, lambda x, i: F.when(x.isin(*W.ROLE_PREPOSITIONS), i)))
    verb = F.get(w, at - 1)
    return F.when((at > 0) & ~verb.isin(*W.ROLE_PREPOSITIONS), F.struct(stem(verb).alias("verb"), F.get(w, at).alias("prep")))


#: Prepositions that mark the same role.
SAME_ROLE = (("in", "into"), ("in", "within"), ("on", "onto"), ("on", "upon"))


def roles_conflict(a: Column, b: Column) -> Column:
    """Same verb with prepositions of different roles."""
    x, y = verb_preposition(a), verb_preposition(b)
    pair = F.concat_ws(" ", F.least(x["prep"], y["prep"]), F.greatest(x["prep"], y["prep"]))
    return F.coalesce((x["verb"] == y["verb"]) & (x["prep"] != y["prep"]) & ~pair.isin(*(" ".join(sorted(p)) for p in SAME_ROLE)), F.lit(False))


def partial_ratio(needle: str, text: str) -> float:
    """Best likeness of the shorter string to any part of the longer, by matching blocks; 1 if it is contained."""
    a, b = sorted((needle, text), key=len)
    if not a:
        return 0.0
    if a in b:
        return 1.0
    best = 0.0
    for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        at = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, a, b[at : at + len(a)], autojunk=False).ratio())
    return best


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(needle: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else partial_ratio(a, b) for a, b in zip(needle, text, strict=True)], dtype=float)


def fuzzy_presence(needle: Column, text: Column) -> Column:
    """1 where the text contains the needle; only other rows go to Python."""
    a, b = F.lower(needle), F.lower(text)
    return F.when(b.contains(a), 1.0).otherwise(partial_ratio_udf(a, b))


def citation_refs(answer: Column, most: Column | int) -> Column:
    """Distinct numbers in square brackets from 1 to most, in order of appearance."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most)))


def preview(text: Column, longest: int = 300) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit("..."))).otherwise(text)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


GREETINGS = ("hello", "hey", "hi", "hola", "sup", "what's up", "whats up", "yo")
OFF_DOMAIN = r"(?:buy|order) (?:me a |me|pizza|a car)|order me a pizza|book (?:me )?(?:a )?flight|(?:rent|lease|purchase|need|want) a car|price of a car|plane tickets?"
UNSAFE = r"(?:how to make|build) a (?:bomb)|(?:make|build) a gun|(?:poison|harm|kill) someone|weapon instructions|suicide|self[ -]harm|overdose|explosive|molotov|credit card fraud|steal credit card|hack|phishing|malware|ransomware"


def is_irrelevant(question: Column) -> Column:
    """Greetings, errands and short requests about cars."""
    q = strip(F.lower(question))
    w = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    short = F.size(w) <= 8
    cars, wishes = (F.array(*map(F.lit, x.split())) for x in ("auto car cars vehicle", "book buy lease need order price purchase rent want"))
    return q.isin(*GREETINGS) | ((F.size(w) <= 3) & q.rlike("^(?:hey|hi|hello|yo|sup) ")) | q.rlike(OFF_DOMAIN) | (short & F.arrays_overlap(w, cars) & F.arrays_overlap(w, wishes))


def is_unsafe(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit(""))).rlike(UNSAFE)


_HEADER_ONLY = re.compile(r"(?:sources|references|citations)\s*:?")


def _inventory(paragraph: str) -> bool:
    t = paragraph.strip()
    if len(re.findall(r"\[\d+\]", t)) < 2 or not re.match(r"\[\d+\]", t):
        return False
    return any(q in t for q in '"“”') or re.search(r"\n\s*\[\d+\]", t) is not None


def strip_inventory(answer: str) -> str:
    """An answer without paragraphs at its end that only list citations, and without the header they leave."""
    if not answer.strip():
        return ""
    parts = answer.split("\n\n")
    while parts and _inventory(parts[-1]):
        parts.pop()
    while parts and _HEADER_ONLY.fullmatch(parts[-1].strip().lower()):
        parts.pop()
    return "\n\n".join(parts).rstrip()


@F.pandas_udf(T.StringType())
def strip_inventory_udf(s: pd.Series) -> pd.Series:
    return s.map(strip_inventory, na_action="ignore")


def is_category_label(x: Column, generic: tuple[str, ...], types: tuple[str, ...] = ()) -> Column:
    """A subtype's name: four characters to six words, one of them generic, and no base type itself."""
    label = F.regexp_replace(strip(x), r"\s+", " ")
    w = F.filter(F.transform(F.split(F.lower(label), " "), lambda y: F.regexp_replace(y, r"""^[.,:;!?()\[\]{}"']+|[.,:;!?()\[\]{}"']+\z""", "")), lambda y: y != "")
    known = F.lower(label).isin(*map(str.lower, types)) if types else F.lit(False)
    return F.coalesce(~known & (F.length(label) >= 4) & (F.size(w).between(1, 6)) & F.exists(w, lambda y: y.isin(*generic)), F.lit(False))
