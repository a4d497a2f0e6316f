"""Text functions over columns: section names, identity facts, counts. All stay in the JVM.

Patterns are Unicode-aware ((?U)): word characters and borders mean what they mean in any
language.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section names in the order in which they are tried, with their headings.
SECTIONS = {
    "Abstract": r"^(abstract|summary)\b[:.\s]*$",
    "Introduction": r"^(introduction|background)\b",
    "Related Work": r"^(related\s+works?|literature\s+(review|survey))\b",
    "Methodology": r"^(methods?|methodology|materials?\s+and\s+methods?|experimental(s|\s+(setup|section|design))?|system\s+(design|architecture|model)|proposed\s+(method|approach|scheme)|approach)\b",
    "Results": r"^(results?(\s*(and|&)\s*discussion)?|discussion|evaluation|experiments?(al\s+results)?|analysis)\b",
    "Conclusion": r"^(conclusions?|concluding\s+remarks?|final\s+remarks?)\b",
    "References": r"^(references|bibliography|works\s+cited)\b[:.\s]*$",
}
# Patterns of numbering, keyword lines, bibliography entries and identity facts.
NUMBERING = r"^(\d+(\.\d+)*[.)]?|[IVXLCDM]+[.)]?)\s+"
KEYWORDS = r"^(keywords?|index\s+terms)\s*[—–·:\-.]"
ENTRY = r"^[A-Z][\w'’\-]+(?:\s+[A-Z][\w'’\-]+)?,(?:\s*[A-Z]\.(?:\s*[A-Z]\.)*|(?:\s+[A-Z][\w'’\-]+,\s*[A-Z]\.)+)[^:]{0,120}:"
ENTRY_YEAR = r"(\(?(?:19|20)\d{2}[a-z]?\)?)"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"
ORCID = r"\b(?:\(?\d{4}\)?[-\s]?){3}\d{3}[\dXx]\b"
URL = r"(?i)https?://[^\s,;)\]]+|www\.[^\s,;)\]]+"
HINTS = (
    r"(\buniversit|\binstitut|\bcollege\b|\bschool\s+of|\bdepartment|\bfaculty\b|\blaborator|\blab\b|\bcentre\b|\bcenter\s+for|"
    r"\bacademy\b|\bpolytechnic|\bhospital|\bresearch\s+(?:centre|center)|\binc\.|\bllc\b|\bltd\.?|\bcorp\.|\bfoundation\b|\bclinic\b|"
    r"\btechnolog(?:y|ical)\s+institute)"
)
AFFILIATION = r"[^.;\n]{0,70}" + HINTS + r"[^.;\n]{0,40}"
NOT_A_NAME = r"(\buniversit|\binstitut|\bcollege\b|\bdepartment|@|\babstract\b|\bkeywords\b)"
ACK_HEADING = r"\backnowledg"
ACK_PHRASE = r"\b(we (thank|gratefully acknowledge|acknowledge)|this (work|research) (was|is) (supported|funded)|the authors (thank|acknowledge))\b"
FUNDING = r"(\b(funded|funded by|supported by|grant(?:s)?|award(?:s)?|grant no|award no|project no|r\d{2}[A-Z]{2}\d{4,}|nsf|erc|dst[ie]|nih|erc|eu horizon)\b)"
SELF_CITATION = (
    r"\b(our (previous|earlier|prior|former) (work|paper|papers|results|study|studies|approach|method)|"
    r"we (previously|earlier) (proposed|presented|introduced|showed|published|described)|in our (previous|earlier) (work|paper|study)\b)"
)
PLACEHOLDER = r"\b(anonymous|anonymised|anonymized|author(?:s)? withheld|double[\s-]blind|under\s+(?:double\s+)?(?:blind\s+)?review|for\s+peer\s+review|manuscript\s+id)\b"
FIGURE = r"\b(?:fig(?:ure)?s?\.?)\s*(\d{1,3})\b"
TABLE = r"\b(?:tab(?:le)?s?\.?)\s*(\d{1,3})\b"
EQUATION = r"\b(?:eq(?:uation)?s?\.?)\s*\(?(\d{1,3})\)?\b"
REFERENCE_YEAR = r"\(?\b(?:19|20)\d{2}[a-z]?\b\)?"
HEADING_NUMBER = r"^\s*(\d+(?:\.\d+)*)[.)]?\s+"
REFERENCE_SPLIT = r"(?=\[\d{1,3}\])|(?=\(\d{1,3}\))|(?<=\.)\s+(?=[A-Z][a-z]+,?\s+[A-Z])"
# Words that are no part of a person's name.
NO_NAMES = [
    "abstract", "introduction", "conclusion", "results", "methodology", "references", "keywords", "affiliation", "university", "department",
    "institute", "email", "corresponding", "author", "authors", "google", "scholar", "orcid", "the", "and", "for", "with", "using", "based",
    "via", "from", "toward", "towards", "state", "national", "technical", "polytechnic", "federal", "central", "royal", "public", "private",
    "science", "sciences", "technology", "engineering", "medicine", "research", "advanced", "higher", "learning", "applied", "pure",
]
# Endings of font names that tell a style.
FONT_STYLES = (
    "bolditalic", "italicbold", "boldoblique", "obliquebold", "semibold", "extralight", "psmt", "ps", "mt", "std", "pro",
    "bold", "light", "book", "medium", "regular", "oblique", "italic",
)
SNIPPET = 400
# Unicode-aware borders are slow to look for. Before a word character a border can't follow an ASCII
# letter, which is quick to see; so patterns that begin with words look there first. All hints do.
WORD = r"(?<![A-Za-z0-9_])\b"
AT_WORDS = (ACK_PHRASE, FUNDING, SELF_CITATION, PLACEHOLDER, FIGURE, TABLE, EQUATION)
HINT = WORD + "(?:" + HINTS[1:-1].replace(r"|\b", "|").removeprefix(r"\b") + ")"
#: Characters that a match of AFFILIATION has before its hint and after it, at most.
BEFORE, AFTER = 70, 40


def _u(p: str, ignore_case: bool = False) -> str:
    if p in AT_WORDS:
        p = p.replace(r"\b", WORD, 1)
    return ("(?iuU)" if ignore_case else "(?U)") + p


def strip_numbering(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _u(NUMBERING, True), ""))


def canonical_section(text: Column) -> Column:
    """The section that a heading names, or null; the first pattern that fits wins."""
    bare, out = strip_numbering(text), F.lit(None).cast("string")
    for name, p in reversed(SECTIONS.items()):
        out = F.when(bare.rlike(_u(p, True)), F.lit(name)).otherwise(out)
    return out


def is_keywords_line(text: Column) -> Column:
    return strip_numbering(text).rlike(_u(KEYWORDS, True))


def keywords_text(text: Column) -> Column:
    """What follows the label of a keywords line."""
    return F.regexp_replace(F.regexp_replace(strip_numbering(text), _u(KEYWORDS, True), ""), r"^[ :.—-]+|[ :.—-]+$", "")


def is_caps_heading(text: Column) -> Column:
    return (F.length(text) <= 90) & (text == F.upper(text)) & (text != F.lower(text))


def is_reference_entry(text: Column) -> Column:
    t = F.trim(text)
    return (t != "") & (F.length(t) <= 600) & t.rlike(_u(ENTRY)) & t.rlike(ENTRY_YEAR)


def title_case(text: Column) -> Column:
    """A capital after everything that isn't a letter."""
    chars = F.split(F.lower(text), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), distinct_matches(text, _u(EMAIL))).when(text.isNotNull(), F.array().cast("array<string>"))


def orcids(text: Column) -> Column:
    return F.when(text.rlike(_u(r"\d{3}[\dXx]")), distinct_matches(text, _u(ORCID))).when(text.isNotNull(), F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda x: F.regexp_replace(x, r"\.+$", ""))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 20)


def _near_hints(text: Column) -> Column:
    """What of a text can be part of an affiliation: from every place only BEFORE characters are
    tried to reach a hint, which is slow where there is none. The text is cut before every hint, and
    what is farther from both its ends than a match reaches gives way to a bar that no match crosses
    and that makes no border of words at its ends."""
    def reduced(part):
        head = F.length(F.regexp_extract(part, _u("^" + HINT, True), 0)) + AFTER + 2
        long = F.length(part) > head + BEFORE + 2
        return F.when(long, F.concat(F.substring(part, F.lit(1), head), F.lit("_;_"), F.substring(part, -(BEFORE + 2), BEFORE + 2))).otherwise(part)

    parts = F.split(text, _u(f"(?={HINT})", True))
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, reduced), "")).otherwise(F.when(text.rlike(_u("^" + HINT, True)), text).when(text.isNotNull(), ""))


def affiliations(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(_near_hints(text), F.lit(_u(AFFILIATION.replace(HINTS, HINT), True)), F.lit(0)), lambda x: F.substring(F.trim(x), 1, SNIPPET))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 10)


def person_names(text: Column, title: Column) -> Column:
    """Runs of two to four capitalised words that are no stop words, without those wholly in
    the title; distinct, in order. Each sentence is cut where an affiliation begins."""
    title_words = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.;,])\s+"), lambda s: (F.trim(s) != "") & (F.length(F.trim(s)) <= 200))
    bare = F.transform(sentences, lambda s: F.regexp_replace(F.trim(s), r"(?isU)" + NOT_A_NAME + r".*$", ""))
    part = lambda w: F.regexp_replace(w, r"[^A-Za-z'\-]", "")
    good = lambda c: c.rlike("^[A-Z]") & ~F.lower(c).isin(*NO_NAMES)
    # Words that break a run become a bar; runs are what stands between bars.
    marked = F.transform(bare, lambda s: F.array_join(F.transform(F.split(s, r"\s+"), lambda w: F.when(good(part(w)), part(w)).otherwise("|")), " "))
    runs = F.flatten(F.transform(marked, lambda s: F.transform(F.split(s, r"\|"), lambda r: F.trim(r))))
    sized = F.filter(runs, lambda r: F.size(F.split(r, " ")).between(2, 4))
    return F.array_distinct(F.filter(sized, lambda r: ~F.forall(F.split(r, " "), lambda w: F.array_contains(title_words, F.lower(w)))))


def window_at(text: Column, pattern: str, before: int, after: int) -> Column:
    """The text around the first match, or null."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + after))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_u(pattern, True))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_u(pattern, True)))


def largest_number(text: Column, pattern: str) -> Column:
    """The largest number that a pattern's first group finds, 0 without any."""
    n = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_u(pattern, True)), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(n), F.lit(0))


def reference_parts(text: Column) -> Column:
    """Entries of one bibliography block: at least one if it has text."""
    parts = F.filter(F.split(F.trim(text), REFERENCE_SPLIT), lambda x: F.trim(x) != "")
    return F.when(F.trim(text) == "", 0).otherwise(F.greatest(F.lit(1), F.size(parts)))


def keyword_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def footnotes(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s*\d+\s{2,}\S"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_font(name: Column) -> Column:
    """A font's family: without subset prefix, hyphens and all style endings (but what is
    nothing else), camel case split, capitals where it has one case. Null without a name."""
    styles = "|".join(FONT_STYLES)
    base = F.regexp_replace(F.regexp_replace(name, "^.*\\+", ""), "[-_]+", "")
    # A whole name that is one style stays; else every ending goes, down to one character.
    bare = F.when(base.rlike(f"(?i)^(?:{styles})$"), base).otherwise(F.regexp_replace(base, f"(?i)(?<=.)(?:{styles})+$", ""))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(bare, "(?<=[a-z])(?=[A-Z])", " "), "\\s+", " "))
    one_case = (F.upper(spaced) != F.lower(spaced)) & ((spaced == F.upper(spaced)) | (spaced == F.lower(spaced)))
    return F.when(spaced != "", F.when(one_case, title_case(spaced)).otherwise(spaced))
