"""Token, text and set expressions: Columns in, Columns out, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no evidence.
EVIDENCE_STOPWORDS = """about after again also and any are before both but can could date did does for from had has have
her him his how into its last many month more most much next not own said she that the their them then there they this time
was week were what when where which who why will with would year""".split()

# Words ignored when a unit is compared with its sources.
UNIT_STOPWORDS = "a an and are as at be but for from i in is it me my of on or she that the they this to was we you".split()

# Words ignored when evidence is looked for in retrieved texts.
RECALL_STOPWORDS = """a an and are as at be but by for from had has have he her his i in is it its me my of on or our she
that the their them they this to was we were with you your""".split()

# Words ignored when failures are classified.
FAILURE_STOPWORDS = """the and for with from that this her his their did when what where who had has have was were will would
could about before after week month year years date time""".split()

# Words that make a question temporal.
TEMPORAL_TERMS = """after before date day friday january february march april may june july august september october november
december last monday month next saturday sunday thursday time today tomorrow tuesday wednesday week when year yesterday""".split()

# Words and years that name a date.
DATE_WORDS = """jan january feb february mar march apr april may jun june jul july aug august sep september oct october nov
november dec december mon monday tue tuesday wed wednesday thu thursday fri friday sat saturday sun sunday yesterday tomorrow
last next""".split()

# Signs of an answer that declines.
ABSTENTIONS = ["not specify", "not specified", "not mentioned", "no information", "not available", "do not know", "don't know", "cannot determine"]

MONTHS = {name: f"{i // 2 + 1:02d}" for i, name in enumerate("jan january feb february mar march apr april may may jun june jul july aug august sep september oct october nov november dec december".split())}


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def raw_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(text: Column, least: int = 3, stopwords: list[str] = EVIDENCE_STOPWORDS) -> Column:
    """Distinct content words of a text."""
    long = F.filter(raw_tokens(text), lambda t: F.length(t) >= least)
    return F.array_except(long, strings(stopwords)) if stopwords else F.array_distinct(long)


def plain_tokens(text: Column) -> Column:
    return content_tokens(text, stopwords=[])


def recall_tokens(text: Column) -> Column:
    return content_tokens(text, 2, RECALL_STOPWORDS)


def listed_tokens(text: Column, least: int, stopwords: list[str], pattern: str = "([a-z0-9]+)") -> Column:
    """Content words in order, repeats included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(stopwords))


def unit_tokens(text: Column) -> Column:
    return listed_tokens(text, 2, UNIT_STOPWORDS, "([A-Za-z0-9']+)")


def failure_tokens(text: Column) -> Column:
    return listed_tokens(text, 3, FAILURE_STOPWORDS)


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 if either is empty."""
    shared = overlap(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.size(F.array_union(a, b)))


def coverage(query: Column, memory: Column) -> Column:
    """Share of the query's words that the memory has."""
    return overlap(query, memory) / F.greatest(F.lit(1), F.size(query))


def has_date_word(text: Column) -> Column:
    """Whether a date word or a year of this century is among the words."""
    words = raw_tokens(text)
    return F.arrays_overlap(words, strings(DATE_WORDS)) | F.exists(words, lambda w: w.rlike("^20[0-9]{2}$"))


def date_terms(text: Column) -> Column:
    """Date words and years in the order of their first use."""
    return F.array_distinct(F.filter(raw_tokens(text), lambda w: F.array_contains(strings(DATE_WORDS), w) | w.rlike("^20[0-9]{2}$")))


def is_temporal(query: Column) -> Column:
    return F.arrays_overlap(raw_tokens(query), strings(TEMPORAL_TERMS))


def length_penalty(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 1800, F.least(F.lit(0.08), (n - 1800) / 10000)).otherwise(0.0)


def evidence_score(cover: Column, date_cue: Column) -> Column:
    return F.least(F.lit(1.0), 0.75 * cover + 0.25 * date_cue)


def add_label(labels: Column, label: Column | str) -> Column:
    """A '+'-joined list with the label appended once."""
    label = F.lit(label) if isinstance(label, str) else label
    parts = F.concat(F.split(F.coalesce(labels, F.lit("")), "[+]"), F.array(label))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "+")


def snippet(text: Column, most: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def abstained(answer: Column, markers: list[str] = ABSTENTIONS) -> Column:
    return F.lower(answer).rlike("|".join(map(re.escape, markers)))


def temporal_fact_context(text: Column) -> Column:
    return F.lower(text).rlike("fact/event date|valid date range|valid_at")


def with_photo(text: Column, caption: Column, query: Column) -> Column:
    """A turn's text with its photo, searched for or captioned, in brackets."""
    shared = F.concat(F.lit("[Sharing image"), F.when(query != "", F.concat(F.lit(" - query: "), query)).otherwise(""), F.when(caption != "", F.concat(F.lit(" - caption: "), caption)).otherwise(""), F.lit("]"))
    none = (F.coalesce(caption, F.lit("")) == "") & (F.coalesce(query, F.lit("")) == "")
    return F.when(none, text).when(F.coalesce(text, F.lit("")) == "", shared).otherwise(F.concat_ws(" ", text, shared))


def final_answer(text: Column, cut_after_semicolon: bool = False) -> Column:
    """The text after the last ANSWER: mark, thoughts taken out."""
    plain = F.regexp_replace(text, "(?s)<(think|thinking|mem_thinking)>.*?</\\1>", "")
    answer = F.trim(F.substring_index(plain, "ANSWER:", -1))
    return F.trim(F.substring_index(answer, ";", 1)) if cut_after_semicolon else answer


def estimated_tokens(text: Column) -> Column:
    """A quarter for each ASCII character, two thirds for any other."""
    ascii_chars = F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", ""))
    return F.floor(ascii_chars / 4 + (F.length(text) - ascii_chars) / 1.5).cast("long")


def sentences(text: Column) -> Column:
    """Sentences of a text: split after . ! ? before white space, and at line ends; the whole text if nothing is left."""
    parts = F.flatten(F.transform(F.split(F.trim(text), "(?<=[.!?])[ \\t\\n\\r\\f\\x0B]+"), lambda s: F.split(s, "\\n+")))
    kept = F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", ""))), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


#: A verb, without word boundaries.
VERB = "(?i)(is|are|was|were|have|has|had|do|does|did|will|would|can|could|should|may|might|[a-z0-9_](ed|ing)([^a-z0-9_]|$))"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != ""))


def complete(text: Column) -> Column:
    """Whether a sentence has two words and something like a verb."""
    return (n_words(text) >= 2) & text.rlike(VERB)


def clauses(text: Column) -> Column:
    """Parts of a long sentence: at commas and semicolons that don't follow a digit, or, where there is none, after conjunctions."""
    at_signs = F.split(text, "(?<=[^0-9])[,;](?=\\s+[\\p{L}\\p{N}_])")
    after_words = F.split(F.regexp_replace(text, "(?i)\\s+(and|but|or|however|therefore|moreover|meanwhile)\\s+", " $1\u0001"), "\u0001")
    parts = F.when(F.size(at_signs) > 1, at_signs).otherwise(after_words)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def source_bound(text: Column, source: Column) -> Column:
    """Whether a rewritten unit stays with its source: not much longer, and with 45 % of its words.

    The words of both are sorted together, so that long texts take n log n and not every pair of words.
    """
    own, words = unit_tokens(text), unit_tokens(source)
    marked = F.sort_array(F.concat(F.transform(F.array_distinct(own), lambda w: F.struct(w.alias("w"), F.lit(0).alias("of"))), F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(1).alias("of")))))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"))
    count = lambda s, x: F.struct(F.when(x["of"] == 0, x["w"]).otherwise(s["last"]).alias("last"), (s["n"] + F.when((x["of"] == 1) & (x["w"] == s["last"]), 1).otherwise(0)).alias("n"))
    kept = F.aggregate(marked, start, count)["n"]
    short = F.length(text) <= F.greatest(2 * F.length(source) + 120, F.lit(240))
    return short & ((F.size(words) < 4) | (kept / F.greatest(F.lit(1), F.size(words)) >= 0.45))


def bare_evidence(text: Column) -> Column:
    """Evidence without its reference in brackets and its speaker."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^\\[[^\\]]*\\][ \\t\\n]*", ""), "^[A-Za-z][A-Za-z '\\-]{0,40}:[ \\t\\n]*", ""))


def yes_no(text: Column) -> Column:
    """Verdict of a reply: the last line that is only yes or no, else the last such word, else null."""
    tail = F.lower(F.substring_index(text, "</think>", -1))
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda s: F.regexp_replace(s, "[^a-z]", "")), lambda s: s.isin("yes", "no"))
    words = F.regexp_extract_all(tail, F.lit("(?:^|[^a-z])(yes|no)(?=[^a-z]|$)"), F.lit(1))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.try_element_at(words, F.lit(-1))) == "yes"
