"""How well a source answers a question: relevance, directness, specificity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a device or part (fixed values).
STOP = tuple("the and for with from that this does will phone phones part parts which what compatible compatibility replacement genuine original price buy sale new used".split())
#: Wordings, in lower case, that state a fit, and that deny one (fixed values).
SUPPORTS = (
    r"\bcompatible with\b", r"\b(?:is|are)\s+compatible\b", r"\bfits\s+(?:the\s+)?[a-z0-9]", r"\bwill fit\b", r"\bfit(s)? for\b", r"\breplacement for\b", r"\bsuitable for\b",
    r"\bworks? with\b", r"\binterchangeable with\b", r"\bused (?:in|with)\b", r"\bdesigned for\b", r"\boem (?:part )?for\b",
)
OPPOSES = (r"\bnot compatible\b", r"\bincompatible\b", r"\b(?:does not|doesn't|will not|won't) fit\b", r"\bnot interchangeable\b", r"\bdifferent (?:connector|flex|layout)\b", r"\bnot for\b")
#: Relevance looks at so many characters of a text.
LOOKED_AT = 4_000


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def terms(c: Column) -> Column:
    """Words of three characters or more that are not stop words, in order, with repeats."""
    return F.filter(F.split(F.lower(_or_empty(c)), "[^a-z0-9+]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP))


def lowered(models: Column) -> Column:
    return F.transform(F.coalesce(models, F.array().cast("array<string>")), F.lower)


def _number(number: Column) -> Column:
    """The part number in lower case as an array, empty where there is none."""
    return F.when(_or_empty(number) != "", F.array(F.lower(number))).otherwise(F.array().cast("array<string>"))


def key_terms(device: Column, part: Column, models: Column, number: Column) -> Column:
    return F.array_distinct(F.concat(terms(device), terms(part), lowered(models), _number(number)))


def sentences(c: Column) -> Column:
    """Sentences of 12 to 400 characters, parted after ``.!?;:`` with white space and at newlines."""
    marked = F.regexp_replace(c, r"([.!?;:])[ \t\r\n]+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: F.length(s).between(12, 400))


def _within(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: text.contains(w))


def wanted_terms(device: Column, part: Column, models: Column, number: Column) -> Column:
    """Struct of what a question asks for: terms of the device and the part, models, number, the terms of each side of a claim, and all key terms.

    It is worked out once for each question; the functions below take it as it is.
    """
    d, p, m, n = terms(device), terms(part), lowered(models), _number(number)
    return F.struct(
        d.alias("device"), p.alias("part"), m.alias("models"), n.alias("number"), F.array_distinct(F.concat(d, m)).alias("devices"), F.array_distinct(F.concat(p, n)).alias("parts"),
        F.array_distinct(F.concat(d, p, m, n)).alias("all"),
    )


def relevance(title: Column, snippet: Column, text: Column, asked: Column) -> Column:
    """Share of the key terms that the page has (0.7 of them count as all), more if it has a model or part number."""
    seen = F.lower(F.concat_ws("\n", _or_empty(title), _or_empty(snippet), F.substring(_or_empty(text), 1, LOOKED_AT)))
    wanted = asked["all"]
    share = F.least(F.lit(1.0), F.size(F.filter(wanted, lambda w: seen.contains(w))) / F.greatest(F.lit(2), F.ceil(F.size(wanted) * F.lit(0.7))))
    model = F.least(F.lit(1.0), share + F.when(_within(seen, asked["models"]), 0.2).otherwise(0.0))
    return F.when(F.size(wanted) == 0, 0.4).otherwise(F.least(F.lit(1.0), model + F.when(_within(seen, asked["number"]), 0.1).otherwise(0.0)))


def directness(title: Column, text: Column, asked: Column) -> Column:
    """Struct (score, explicit, opposed): the best sentence by how closely device, part and a wording of fit meet.

    Only sentences with the device or the part are looked at for wordings.
    """

    def named(sentence: Column) -> Column:
        return F.struct(sentence.alias("s"), _within(sentence, asked["devices"]).alias("d"), _within(sentence, asked["parts"]).alias("p"))

    def judge(n: Column) -> Column:
        return F.struct(n["d"].alias("d"), n["p"].alias("p"), n["s"].rlike("|".join(SUPPORTS)).alias("yes"), n["s"].rlike("|".join(OPPOSES)).alias("no"))

    low = F.transform(sentences(F.concat(_or_empty(title), F.lit(". "), _or_empty(text))), F.lower)
    judged = F.transform(F.filter(F.transform(low, named), lambda n: n["d"] | n["p"]), judge)
    score = lambda j: F.when(j["yes"] & j["d"] & j["p"], 1.0).when(j["yes"] | j["no"], 0.6).when(j["d"] & j["p"], 0.45).otherwise(0.2)
    start = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("explicit"), F.lit(False).alias("opposed"))
    step = lambda h, j: F.struct(F.greatest(h["score"], score(j)).alias("score"), (h["explicit"] | (j["yes"] & j["d"] & j["p"])).alias("explicit"), (h["opposed"] | (j["no"] & j["d"] & j["p"])).alias("opposed"))
    finish = lambda h: F.struct(F.when(h["score"] == 0, 0.1).otherwise(h["score"]).alias("score"), h["explicit"].alias("explicit"), h["opposed"].alias("opposed"))
    return F.aggregate(judged, start, step, finish)


def page_of(title: Column, text: Column) -> Column:
    return F.lower(F.concat_ws(" ", _or_empty(title), _or_empty(text)))


def model_specificity(page: Column, asked: Column) -> Column:
    """1 with a model number asked for, 0.65 with all words of the device's name, 0.4 with some; ``page`` is that of :func:`page_of`."""
    words = asked["device"]
    return F.when(_within(page, asked["models"]), 1.0).when((F.size(words) > 0) & F.forall(words, lambda w: page.contains(w)), 0.65).when(_within(page, words), 0.4).otherwise(0.0)


def part_specificity(page: Column, asked: Column, category: Column) -> Column:
    """1 with the part number, 0.75 with all words of the part's name, 0.45 with some or the category, else 0.1."""
    words = asked["part"]
    some = _within(page, words) | F.coalesce(page.contains(category), F.lit(False))
    return F.when(_within(page, asked["number"]), 1.0).when((F.size(words) > 0) & F.forall(words, lambda w: page.contains(w)), 0.75).when(some, 0.45).otherwise(0.1)
