"""Condition tags: what sets apart the price tables of one product. A tag is 'dimension: value'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planwatch.functions.text import let, tokens

#: Fixed value: copay "com" is met by both kinds.
WIDE = ("coparticipação: com", ("coparticipação: com", "coparticipação: parcial", "coparticipação: total"))
#: Kinds that a word names where it follows another.
KINDS = {"tabela": ("aberta", "fechada", "estudantil"), "copart": ("parcial", "total")}
SIZES = ("i", "ii", "iii")


def _at(i: Column, words: Column):
    """The word so many places from i; null outside."""
    return lambda k: F.when(i + k >= 0, F.get(words, (i + k).cast("int")))


def _tags_at(word) -> list[Column]:
    """The tags that the word at a place gives with its neighbours; null where it gives none."""
    number = lambda k: F.when(word(k).rlike("^[0-9]{1,3}$"), word(k).cast("int").cast("string"))
    tag = lambda dimension, *value: F.concat(F.lit(f"{dimension}: "), *[x if isinstance(x, Column) else F.lit(x) for x in value])
    here = word(0)
    from_on = ((word(-2) == "de") & (word(-3).isin("acima", "mais") | ((word(-3) == "partir") & (word(-4) == "a")))) & number(-1).isNotNull()
    between = word(-2).isin("a", "-", "ate") & number(-3).isNotNull() & number(-1).isNotNull()
    kind = lambda name, k: F.coalesce(*[F.when(word(k).startswith(x), F.lit(x)) for x in KINDS[name]])
    return [
        F.when((here == "vidas") & between, tag("vidas", number(-3), " a ", number(-1))),
        F.when((here == "vidas") & from_on, tag("vidas", number(-1), " ou mais")),
        F.when((here == "vida") & (number(-1) == "1"), tag("vidas", "1")),
        F.when(F.contains(here, F.lit("compuls")), tag("adesão", "compulsória")),
        F.when((here == "livre") & word(1).startswith("ades"), tag("adesão", "livre")),
        F.when((here == "titular") & ~F.coalesce(word(1) == "+", F.lit(False)), tag("composição", "titular")),
        F.when((here == "titular") & (word(1) == "+") & word(2).rlike("^[0-9]"), tag("composição", "titular + ", F.substring(word(2), 1, 1))),
        F.when(here == "capital", tag("região", "capital")),
        F.when((here == "interior") & word(1).rlike("^[0-9]"), tag("região", "interior ", F.substring(word(1), 1, 1))),
        F.when((here == "porte") & (word(1).isin(*SIZES) | word(1).rlike("^[0-9]$")), tag("porte", F.upper(word(1)))),
        F.when((here == "grupo") & word(1).rlike("^[0-9]+$"), tag("grupo", word(1))),
        F.when(here == "tabela", tag("tabela", kind("tabela", 1))),
    ]


def condition_tags(*texts: Column) -> Column:
    """The sorted distinct tags that the texts state together, read from each word and those beside it.

    Copay kinds that are listed together are what the product offers, not this table's condition, and give no tag."""
    return let(tokens(F.concat_ws(" ", *texts)), _tags_of)


def _tags_of(words: Column) -> Column:
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    each = F.flatten(F.transform(places, lambda i: F.array(*_tags_at(_at(i, words)))))
    listed = lambda word: F.array(word(1), F.when(word(1).isin(*KINDS["copart"]), F.when(word(2).isin("ou", "e", "/", ","), word(3)).otherwise(word(2))))
    copay = lambda f: F.filter(places, lambda i: F.coalesce(_at(i, words)(0).startswith("copart") & f(_at(i, words)), F.lit(False)))
    named = F.flatten(F.transform(copay(lambda w: F.lit(True)), lambda i: listed(_at(i, words))))
    kinds = F.array_distinct(F.filter(named, lambda x: F.coalesce(x.isin(*KINDS["copart"]), F.lit(False))))
    beside = lambda x: F.size(copay(lambda w: w(-1) == x)) > 0
    said = let(kinds, lambda k: F.when(F.size(k) == 1, F.get(k, F.lit(0))).when(F.size(k) > 1, F.lit(None)).when(beside("sem"), F.lit("sem")).when(beside("com"), F.lit("com")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(each, F.array(F.concat(F.lit("coparticipação: "), said))), lambda x: x.isNotNull())))


def dimensions(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, lambda x: F.substring_index(x, ": ", 1)))


def combined(*sources: Column) -> Column:
    """Tags of several sources: for each dimension those of the first source that says something."""
    taken = sources[0]
    for more in sources[1:]:
        unsaid = lambda seen: lambda x: ~F.array_contains(seen, F.substring_index(x, ": ", 1))
        taken = F.concat(taken, F.filter(more, unsaid(dimensions(taken))))
    return F.array_sort(F.array_distinct(taken))


def compatible(a: Column, b: Column) -> Column:
    """In each dimension that both speak of they have a value in common."""
    wide = lambda tags: F.flatten(F.transform(tags, lambda x: F.when(x == WIDE[0], F.array(*map(F.lit, WIDE[1]))).otherwise(F.array(x))))
    return F.size(F.array_except(F.array_intersect(dimensions(a), dimensions(b)), dimensions(F.array_intersect(wide(a), wide(b))))) == 0
