"""Column expressions over tokens, tags and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 19 punctuation characters removed from description ids.
ID_PUNCTUATION = ",.'\":;?!<>~%$|/@#^*"
# Tokens that never carry a character span.
SPAN_PUNCTUATION = [",", ".", "?", "'", "\"", "!"]
# Tags and words of the number and mention type rules.
PRONOUN_TAGS = ["PRP", "PRP$"]
PROPER_TAGS = ["NNP", "NNPS"]
PLURAL_TAGS = ["NNS", "NNPS"]
PLURAL_PRONOUNS = ["they", "them", "those", "these", "we", "us", "their", "our"]
ONE_WORDS = ["one", "1"]
WORD_CLASSES = ["NOUN", "VERB", "ADJ"]
NULL_TEXT = "###NULL###"
NEW_TEXT = "###NEW###"


# The usual English stop words, apostrophes and their leftovers included.
_STOP = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now
"""


def stop_words() -> list[str]:
    return _STOP.split()


def mention_type(tag: Column) -> Column:
    return (
        F.when(tag.isin(PRONOUN_TAGS), "pronoun")
        .when(tag.isin(PROPER_TAGS), "proper")
        .otherwise("nominal")
    )


def number_of_loader(token: Column, tag: Column) -> Column:
    """Plural tags; a cardinal is plural unless it is one; plural pronouns."""
    return (
        F.when(tag.isin(PLURAL_TAGS), "plural")
        .when((tag == "CD") & token.isin(ONE_WORDS), "singular")
        .when((tag == "CD") | token.isin(PLURAL_PRONOUNS), "plural")
        .otherwise("singular")
    )


def number_of_coreference(token: Column, tag: Column) -> Column:
    """As above, but pronouns by list only and a cardinal is its own value."""
    return (
        F.when(tag.isin(PRONOUN_TAGS) & token.isin(PLURAL_PRONOUNS), "plural")
        .when(tag.isin(PLURAL_TAGS), "plural")
        .when(tag == "CD", token)
        .otherwise("singular")
    )


def word_class(tag_class: Column) -> Column:
    return F.when(tag_class.isin(WORD_CLASSES), tag_class).otherwise("OTHER")


def type_leaf(name: Column) -> Column:
    return F.element_at(F.split(name, "\\."), -1)


def clean_description_id(text: Column, joiner: str | None = None) -> Column:
    cleaned = F.translate(text, ID_PUNCTUATION, "")
    return cleaned if joiner is None else F.replace(cleaned, F.lit(" "), F.lit(joiner))


def video_id(url: Column) -> Column:
    return F.element_at(F.split(url, "v="), -1)


def feature_document(key: Column) -> Column:
    return F.regexp_replace(key, "_[^_]*$", "")


def feature_row(key: Column) -> Column:
    return F.substring_index(key, "_", -1).cast("int")


def edit_ratio(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def string_match(
    text_a: Column, text_b: Column, lemma_a: Column, lemma_b: Column,
    text_limit: float = 0.5, lemma_limit: float = 0.5,
) -> Column:
    return (
        (text_a == text_b)
        | (lemma_a == lemma_b)
        | text_a.contains(text_b)
        | text_b.contains(text_a)
        | (edit_ratio(text_a, text_b) <= text_limit)
        | (edit_ratio(lemma_a, lemma_b) <= lemma_limit)
    )


def acronym_of(text: Column) -> Column:
    words = F.filter(F.split(text, " "), lambda w: ~w.isin(stop_words()) & (w != ""))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def is_acronym(a: Column, b: Column) -> Column:
    bare_a, bare_b = F.translate(a, ".-", ""), F.translate(b, ".-", "")
    return (acronym_of(a) == bare_b) | (acronym_of(b) == bare_a)


def number_match(a: Column, b: Column) -> Column:
    return a == b


def number_match_entity(a: Column, b: Column, lemma_a: Column, lemma_b: Column) -> Column:
    """Plural and numeric may mix; two numerics need the same lemma."""
    mixed = ((a == "plural") & (b == "numeric")) | ((a == "numeric") & (b == "plural"))
    return F.when(a != b, mixed).otherwise((a != "numeric") | (lemma_a == lemma_b))


def is_consecutive(end_a: Column, start_b: Column) -> Column:
    return F.abs(start_b - end_a) <= 1


def plurality_compatible(class_a: Column, tag_a: Column, class_b: Column, tag_b: Column) -> Column:
    plural_a, plural_b = tag_a.endswith("S"), tag_b.endswith("S")
    return (
        F.when((class_a == "NOUN") & (class_b == "NOUN"), plural_a == plural_b)
        .when((class_a == "NOUN") & (class_b == "VERB"), ~plural_a)
        .when((class_b == "NOUN") & (class_a == "VERB"), ~plural_b)
        .otherwise(True)
    )


def pos_compatible(tags_a: Column, tags_b: Column) -> Column:
    """Some pair of tags shares two letters, or both are noun, verb or pronoun."""
    families = ["NN", "VB", "PR"]

    def pair(s: Column, t: Column) -> Column:
        head_s, head_t = F.substring(s, 1, 2), F.substring(t, 1, 2)
        return (
            (head_s == head_t)
            | (head_s.isin(families) & head_t.isin(families))
            | (s == NEW_TEXT)
        )

    return F.exists(tags_a, lambda s: F.exists(tags_b, lambda t: pair(s, t)))


def mode_feature(mode: Column, lemma: Column, *pronoun_parts: Column) -> Column:
    """Word of the translation table: the lemma, or in the discourse modes the
    joined mention features."""
    return F.when(mode.isin("discourse", "pronoun"), F.concat_ws("__", *pronoun_parts)).otherwise(lemma)


def seeded_uniform(seed, *parts: Column) -> Column:
    """Reproducible uniform in (0, 1) from a hash of the row key and a seed."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
