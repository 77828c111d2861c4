"""Text expressions: tokenizers, normalizers, categories, segments."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from mnemoframe.functions import fixed_values as fv

_WORD = "[A-Za-z0-9_]"
_EITHER_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_pattern(pattern: str) -> str:
    r"""``\b`` as an ASCII word edge; Java's own one also counts accented letters.

    Where the pattern itself tells which side the word is on, only the other side
    is looked at, which is much cheaper on long texts.
    """
    opening = re.sub(r"\\b(?=(?:\((?:\?:)?)?(?:[A-Za-z0-9]|\\d))", f"(?<!{_WORD})", pattern)
    closing = re.sub(r"(?<=[A-Za-z0-9)}])\\b", f"(?!{_WORD})", opening)
    return closing.replace(r"\b", _EITHER_EDGE)


def search_terms(text: Column, stop_words=fv.QUERY_STOP_WORDS) -> Column:
    """Lower-case alphanumeric terms of two or more characters, repeats kept."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))


def keyword_query(text: Column) -> Column:
    """Content words joined with `` | ``, the disjunctive text-search form."""
    return F.array_join(search_terms(text), " | ")


def keyword_set(text: Column) -> Column:
    """Distinct content words used to compare two facts."""
    cleaned = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " ")
    words = F.array_distinct(F.split(cleaned, r"\s+"))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*fv.KEYWORD_STOP_WORDS))


def overlap(left: Column, right: Column) -> Column:
    """Shared words over the size of the smaller set; 0 when either is empty."""
    smaller = F.least(F.size(left), F.size(right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(smaller > 0, shared / smaller).otherwise(F.lit(0.0))


def graph_tokens(query: Column) -> Column:
    words = F.transform(
        F.split(query, r"[\s.]+"),
        lambda w: F.lower(F.regexp_replace(w, r"[^A-Za-z0-9_\-]", "")))
    return F.filter(words, lambda w: F.length(w) >= 2)


def entity_name_candidates(query: Column) -> Column:
    """Names under which a query may mention an entity.

    Single tokens, neighbours joined with a space and with a dot, the whole
    query, the query with dots opened up, and ``user`` when it speaks in the
    first person.
    """
    tokens = graph_tokens(query)
    empty = F.array().cast("array<string>")

    def neighbours(sep: str) -> Column:
        return F.when(
            F.size(tokens) >= 2,
            F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1),
                       F.slice(tokens, F.lit(2), F.size(tokens) - 1),
                       lambda a, b: F.concat(a, F.lit(sep), b))).otherwise(empty)

    whole = F.trim(F.lower(query))
    opened = F.trim(F.regexp_replace(F.regexp_replace(whole, r"\.", " "), r"\s+", " "))
    first_person = F.when(
        query.rlike(java_pattern(r"(?i)\b(user|me|my|i)\b")),
        F.array(F.lit("user"))).otherwise(empty)
    names = F.array_distinct(F.concat(
        first_person, tokens, neighbours(" "), neighbours("."), F.array(whole, opened)))
    names = F.filter(names, lambda n: F.length(n) >= 2)
    return F.when(F.size(tokens) > 0, names).otherwise(empty)


def normalized_entity_name(raw: Column) -> Column:
    """Clean lower-case form of an entity name."""
    noise = r"(?i)^(" + "|".join(fv.LEADING_NOISE_WORDS) + r")\s+"
    name = F.trim(raw)
    for pattern in (r"^[-–—*•#>]+\s*", r"(?i)'s$", "(?i)’s$",
                    r"^[^a-zA-Z0-9]+", r"[^a-zA-Z0-9]+$", noise, noise):
        name = F.regexp_replace(name, pattern, "")
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def normalized_relation(relation: Column) -> Column:
    key = F.lower(F.trim(relation))
    pairs = [F.lit(x) for kv in fv.RELATION_SYNONYMS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def strip_role(line: Column) -> Column:
    return F.regexp_replace(line, fv.ROLE_PREFIX, "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, fv.HTML_TAG, "")


def profile_category(content: Column) -> Column:
    lower = F.lower(content)
    out = F.when(F.lit(False), F.lit(""))
    for category, needles in fv.PROFILE_CATEGORIES:
        hit = lower.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | lower.contains(needle)
        out = out.when(hit, F.lit(category))
    return out.otherwise(F.lit("other"))


def contextual_text(content: Column, source_chunk: Column) -> Column:
    """Fact text with its source in front, as embedded at extraction time."""
    source = F.trim(F.coalesce(source_chunk, content))
    return F.concat(F.lit("Context: "), source, F.lit(" | Fact: "), content)


def reembedding_text(content: Column, source_chunk: Column) -> Column:
    """Fact text with its source in front, as used by the re-embedding job."""
    source = F.coalesce(F.nullif(source_chunk, F.lit("")), content)
    return F.concat(F.lit("Context: "), source, F.lit(" | Fact: "), content)


def query_variants(query: Column) -> Column:
    """Up to four rule-made reformulations of a query, the original first."""
    lower = F.lower(query)
    has_my = lower.contains("my ")
    third_person = F.when(
        ~lower.startswith("user") & ~has_my & ~lower.contains("i "),
        F.concat(F.lit("User "), lower))
    possessive = F.when(
        has_my, F.regexp_replace(lower, java_pattern(r"\bmy\b"), "user's"))
    statement = lower
    for pattern in (r"^what (is|are|was|were) ", r"^who (is|are|was|were) ",
                    r"^where (is|are|was|were|does|did) ",
                    r"^when (did|does|was|were|is) ", r"\?$"):
        statement = F.regexp_replace(statement, pattern, "")
    question = lower.rlike("^(what|who|where|when) ") & (statement != lower)
    return F.array_compact(F.array(query, third_person, possessive, F.when(question, statement)))


def priority_label(content: Column) -> Column:
    """Name of a priority: its text without the lead-in."""
    return F.trim(F.regexp_replace(content, fv.PRIORITY_LEAD_IN, ""))


CONTEXT_BEFORE = "[Earlier sentences, to tell what words here refer to]"
CONTEXT_HERE = "[Sentences to read facts from]"
CONTEXT_AFTER = "[Later sentences]"


def segments(text: Column, size: int = fv.SEGMENT_CHARS) -> Column:
    """Whole sentences packed greedily into segments of about ``size`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(state: Column, sentence: Column) -> Column:
        full = (F.length(state["open"]) + F.length(sentence) > size) & (
            F.length(state["open"]) > 0)
        joined = F.when(F.length(state["open"]) > 0,
                        F.concat(state["open"], F.lit(" "), sentence)).otherwise(sentence)
        return F.struct(
            F.when(full, F.array_append(state["done"], F.trim(state["open"])))
            .otherwise(state["done"]).alias("done"),
            F.when(full, sentence).otherwise(joined).alias("open"))

    def close(state: Column) -> Column:
        last = F.trim(state["open"])
        return F.when(F.length(last) > 0, F.array_append(state["done"], last)).otherwise(
            state["done"])

    return F.aggregate(F.split(text, r"(?<=[.!?])\s+"), start, pack, close)


def enriched_segments(text: Column, parts: Column, before: int = fv.SEGMENTS_BEFORE,
                      after: int = fv.SEGMENTS_AFTER) -> Column:
    """Array of ``(index, total, segment, context_window)`` for the extraction prompt.

    ``parts`` is the ``segments`` column, computed in an earlier projection so the
    packing runs once per text.  A text of one segment is its own window; a text
    without a sentence is one empty segment.
    """
    count = F.size(parts)

    def block(title: str, some: Column) -> Column:
        return F.when(F.size(some) > 0, F.concat(F.lit(title + "\n"), F.array_join(some, "\n")))

    def window(segment: Column, i: Column) -> Column:
        context = F.concat_ws("\n\n", block(
            CONTEXT_BEFORE, F.slice(parts, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)))), block(
            CONTEXT_HERE, F.array(segment)), block(CONTEXT_AFTER, F.slice(parts, i + 2, F.lit(after))))
        return F.struct(i.alias("index"), count.alias("total"), segment.alias("segment"),
                        F.when(count == 1, segment).otherwise(context).alias("context_window"))

    whole = F.array(F.struct(F.lit(0).alias("index"), F.lit(1).alias("total"),
                             text.alias("segment"), text.alias("context_window")))
    return F.when(count == 0, whole).otherwise(F.transform(parts, window))
