"""Filters and rules as Column expressions, built from tables of patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

ALPHA = r"^[A-Za-z][A-Za-z \-]*\z"

#: Noise that either end of a triple may hold, and noise of one field alone; % and _ as in LIKE, which ignores case here.
EITHER = """ascii archive-it chapter copyright disclaimer distributor donation ebook gutenberg http librivox license
paragraph%1.e redistribution refund royalty trademark volunteer warranty www michael%hart""".split() + ["public domain", "plain vanilla", "electronic work", "internet archive", "updated editions"]
SUBJECT = [w.strip() for w in """english knowledge; oldest children; patrilocal; matrilocal; father dead; mother dead; parents divorced;
father remarried; half sister; half brother; younger sisters number; older brothers number; best friends; physical defects; menstrual;
test scores; pastor school; obscurae subtilitatis; grynaeus; reimpression; wind noise; hail noise; wheel creaking; trumpet sounds; pipe sounds;
flute sounds; tudududu; has vignette; foundation ein; individual works; hamburger icon; search icon; save page; defect in work;
invalid provision; icon%depicts; subnav; menu item""".split(";")]
PREDICATE = ["on pages", "tax deductible", "appears on page"]
OBJECT = ["within 90 days", "tax deductible", "reasonable fee"]
_FOUNDATION = {"s": ["literary", "archive"], "o": ["809 north", "salt lake", "charity", "501", "mississippi", "tax", "ein"], "p": ["liable", "indemnif"]}


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)


def _has(col: str, words: list[str]) -> list[Column]:
    return [F.lower(col).like(f"%{w}%") for w in words]


def legacy_noise(s: str = "subject_norm", p: str = "predicate_norm", o: str = "object_norm") -> Column:
    """True for boilerplate; null where a null object leaves it open."""
    low = {"s": F.lower(s), "p": F.lower(p), "o": F.lower(o)}
    name = {"s": s, "p": p, "o": o}
    near = [t for k, v in _FOUNDATION.items() for t in _has(name[k], v)] + [low["s"] == "foundation", low["o"] == "foundation"]
    terms = _has(s, EITHER) + _has(o, EITHER) + _has(s, SUBJECT) + _has(p, PREDICATE) + _has(o, OBJECT)
    terms += [
        _any(_has(s, ["foundation"]) + _has(o, ["foundation"])) & _any(near),
        (low["s"] == "user") & low["p"].like("%agree%"),
        low["p"].like("%links to%") & F.col(o).like("/%"),
        low["s"].like("%icon%") & low["p"].like("%depicts%"),
        F.col(s).like("[%]"), F.col(o).like("[%]"), F.col(s).like("1.e.%"), F.col(s).like("1.f.%"),
        low["s"].like("%contributions%") & low["o"].like("%u.s.%"),
        low["s"].like("%web page%") & low["p"].like("%used as%"),
        F.col(s).rlike(r"^[0-9]+,[0-9]+\z"), F.col(s).rlike(r"^[0-9]+-[0-9]+\z"),
        low["s"].like("%dog bark%") & ~low["p"].like("%symbol%"),
        low["s"].like("%sheep bleat%") & ~low["p"].like("%symbol%"),
    ]
    return _any(terms)


def noise(entities: list[str] = (), predicates: list[str] = (), failed: list[str] = (), types: dict[str, list[str]] | None = None, s: str = "subject_norm", p: str = "predicate_norm", o: str = "object_norm") -> Column:
    """Noise by configured LIKE patterns, names that failed provenance, and patterns by type; without any, the legacy rules."""
    terms: list[Column] = []
    for w in sorted(set(entities)):
        terms += [F.lower(s).like(w.lower()), F.lower(o).like(w.lower())]
    terms += [F.lower(p).like(w.lower()) for w in sorted(set(predicates))]
    for w in sorted(set(failed)):
        terms += [F.lower(s) == w.lower(), F.lower(o) == w.lower()]
    for kind, patterns in (types or {}).items():
        for w in patterns:
            terms += [(F.col("subject_type") == kind) & F.lower(s).like(w.lower()), (F.col("object_type") == kind) & F.lower(o).like(w.lower())]
    return _any(terms) if terms else legacy_noise(s, p, o)


def alpha(s: str = "subject_norm", p: str = "predicate_norm", o: str = "object_norm") -> Column:
    """Letters, spaces and hyphens only, more than one of them; the object may be missing."""
    free = F.col(o).isNull() | (F.col(o) == "")
    return F.col(s).rlike(ALPHA) & F.col(p).rlike(ALPHA) & (free | F.col(o).rlike(ALPHA)) & (F.length(F.trim(F.col(s))) > 1) & (free | (F.length(F.trim(F.col(o))) > 1))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


_HEADING = r"(?i)^(?:(?:chapter|section|book|part|volume|appendix|index)\b|[ivxlcdm]+\.\z|\d+(?:[.)]\d+)*\z)"
_NUMERAL = r"(?i)(?:^|[\s_])(?:chapter|section|part|book|volume|appendix)[\s_]+(?:[IVXLCDM]+|\d+)\b"
_INDEX = r"(?i)\bsee\s+(?:also|under)\b|\bcf\.\s"


def chunk_skip_reason(content: str) -> Column:
    """Why a chunk holds nothing to extract, or null."""
    c = F.col(content)
    low = F.lower(c)
    lines = F.slice(F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"), strip), lambda x: x != ""), 1, 80)
    n = F.greatest(F.lit(1), F.size(lines))
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    heads, refs, index = count(_HEADING), count(_NUMERAL), count(_INDEX)
    tokens = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))
    return (
        F.when(c.isNull() | (strip(c) == ""), "empty_chunk")
        .when(_any([low.contains(m) for m in W.LEGAL_MARKERS]), "legal_boilerplate_chunk")
        .when(low.contains("table of contents"), "table_of_contents_chunk")
        .when((heads >= 8) & (heads / n >= 0.5), "structural_heading_chunk")
        .when((refs >= 5) & (refs / n >= 0.3), "toc_like_chapter_listing")
        .when((index >= 3) & (index / n >= 0.15), "index_glossary_chunk")
        .when((tokens <= 50) & (heads / n >= 0.6), "short_header_only_chunk")
    )


def triple_rejection_reason(s: str, p: str, o: str) -> Column:
    """Why a triple is of no use, or null."""
    sub, pre, obj = (strip(F.coalesce(F.col(x), F.lit(""))) for x in (s, p, o))
    ends = {"subject": sub, "object": obj}
    out = None
    tests = [
        ("pronoun", lambda x: F.lower(x).isin(*W.PRONOUNS)),
        ("structural", lambda x: F.lower(x).isin(*W.STRUCTURAL)),
        ("placeholder", lambda x: F.lower(x).rlike(r"^[_\s]*n[._\s]*\z")),
        ("single_letter", lambda x: x.rlike(r"^[A-Za-z]\z")),
        ("very_short_ascii", lambda x: x.rlike(r"^[A-Za-z]{1,2}\z")),
        ("entity_too_long", lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")) > 8),
    ]
    for name, test in tests:
        for end, col in ends.items():
            out = (F.when if out is None else out.when)(test(col), f"{name}_{end}")
    whole = F.lower(F.concat_ws(" ", sub, pre, obj))
    return out.when(_any([whole.contains(m) for m in W.LEGAL_MARKERS]), "legal_boilerplate_triple")


def is_stop_label(label: Column) -> Column:
    x = strip(F.lower(label))
    return x.isin(*W.STOP_LABELS) | ((F.length(x) <= 3) & ~x.isin("god", "man", "one", "two"))


def is_low_quality_label(label: Column) -> Column:
    """Punctuation, no or many words, conjunctions, clause fragments, determiners, mostly function words."""
    x = strip(F.lower(label))
    w = F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0))
    n, first = F.size(w), F.get(w, 0)
    function = F.size(F.filter(w, lambda y: y.isin(*W.FUNCTION_WORDS)))
    middle = F.slice(w, 2, F.greatest(n - 2, F.lit(0)))
    return F.coalesce(
        x.rlike(r"""[-:;"()\[\]]""") | (n == 0) | (n > 4) | ((n >= 3) & F.array_contains(w, "and")) | first.isin(*W.CLAUSE_MARKERS)
        | ((n >= 3) & F.exists(middle, lambda y: y.isin(*W.CLAUSE_MARKERS))) | first.isin(*W.DETERMINERS)
        | ((n > 1) & (function / n > 0.5)) | ((n > 1) & first.isin(*W.FUNCTION_WORDS)),
        F.lit(False),
    )


def predicate_weight(p: Column) -> Column:
    """0 blocked, 0.2 generic, 1.5 telling, else 1."""
    x = strip(F.lower(p))
    return F.when(x.isin(*W.BLOCKED_PREDICATES), 0.0).when(x.isin(*W.GENERIC_PREDICATES), 0.2).when(x.rlike("|".join(W.VALUABLE_PREDICATES)), 1.5).otherwise(1.0)


def count_noise(triples: DataFrame, is_noise: Column, is_alpha: Column) -> DataFrame:
    """One row: all, noisy, non-alphabetic and clean triples."""
    return triples.agg(F.count("*").alias("total"), F.count_if(is_noise).alias("noisy"), F.count_if(~is_alpha).alias("non_alpha"), F.count_if(is_alpha & ~is_noise).alias("clean"))
