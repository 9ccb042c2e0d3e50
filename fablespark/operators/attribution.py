"""Who speaks: names and pronouns beside verbs of speech, genders of names, paragraphs by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import casting

# Verbs of speech, words that are no names, names and endings by gender.
VERBS = (
    "dire", "dit", "disait", "avait dit", "demander", "demanda", "demandait", "questionner", "questionna", "repondre", "repondit", "repondait", "retorquer", "retorqua", "repliquer", "repliqua",
    "s'exclamer", "s'exclama", "s'ecrier", "s'ecria", "crier", "cria", "criait", "hurler", "hurla", "murmurer", "murmura", "murmurait", "chuchoter", "chuchota", "soupirer", "soupira", "gemir", "gemit",
    "grommeler", "grommela", "marmonner", "marmonna", "begayer", "begaya", "ajouter", "ajouta", "ajoutait", "continuer", "continua", "reprendre", "reprit", "poursuivre", "poursuivit", "conclure", "conclut",
    "annoncer", "annoncera", "annoncait", "declarer", "declara", "affirmer", "affirma", "expliquer", "expliqua", "preciser", "precisa", "confirmer", "confirma", "admettre", "admit", "avouer", "avoua",
    "protester", "protesta", "insister", "insista", "supplier", "supplia", "ordonner", "ordonna", "suggerer", "suggera", "proposer", "proposa", "remarquer", "remarqua", "observer", "observa",
    "commenter", "commenta", "lancer", "lancera", "couper", "coupa", "interrompre", "interrompit",
)
NO_NAMES = ("le", "la", "les", "un", "une", "des", "ce", "cette", "ces", "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses", "notre", "nos", "votre", "vos", "leur", "leurs", "qui", "que", "quoi", "dont", "ou", "mais", "donc", "car", "puis", "alors", "ainsi", "bien", "mal", "tout", "tous")
FEMALE = ("marie", "sophie", "claire", "julie", "anne", "sarah", "emma", "lea", "chloe", "manon", "camille", "lucie")
MALE = ("victor", "pierre", "jean", "paul", "marc", "louis", "thomas", "nicolas", "antoine", "julien", "lucas", "hugo", "kamel", "crawford", "momo", "paulo")
FEMALE_ENDINGS = ("e", "a", "ie", "ine", "elle", "ette", "ise", "aine")
MALE_ENDINGS = ("o", "us", "is", "el", "en", "on", "er")
NAME = "[A-ZÀÂÄÉÈÊËÏÎÔÙÛÜÇa-zàâäéèêëïîôùûüç][a-zàâäéèêëïîôùûüç]+"
EMOTIONAL = {
    "fr": ("soudain", "hurla", "cria", "murmura", "sanglota", "rit", "incroyable", "terrible", "merveilleux", "effrayant"),
    "en": ("suddenly", "shouted", "screamed", "whispered", "sobbed", "laughed", "incredible", "terrible", "wonderful", "frightening"),
}


def gender(name: Column | str) -> Column:
    """F, M or null: by the listed first names, then by endings, female ones first."""
    low = F.lower(T.col(name))
    ends = lambda endings: low.rlike(f"({'|'.join(endings)})$")
    return F.when(low.isin(*FEMALE), "F").when(low.isin(*MALE), "M").when(ends(FEMALE_ENDINGS), "F").when(ends(MALE_ENDINGS), "M")


def explicit_speaker(text: Column | str) -> Column:
    """struct(name, gender, confidence) of a name right after a verb of speech (0.95) or before one (0.9); null without one."""
    t, verbs = T.col(text), "|".join(VERBS)
    after = F.regexp_extract(t, rf"(?iuU)\b(?:{verbs})\s+({NAME})", 1)
    before = F.regexp_extract(t, rf"(?iuU)({NAME})\s+(?:{verbs})", 1)
    named = lambda n: (n != "") & ~F.lower(n).isin(*NO_NAMES)
    made = lambda n, c: F.struct(n.alias("name"), gender(n).alias("gender"), F.lit(c).alias("confidence"))
    return T.let(F.struct(after.alias("a"), before.alias("b")), lambda x: F.when(named(x["a"]), made(x["a"], 0.95)).when(named(x["b"]), made(x["b"], 0.9)))


def pronoun_speaker(text: Column | str) -> Column:
    """struct(gender, confidence) of a pronoun tied to a verb of speech (0.8) or before one (0.75); `on` counts as female."""
    t, verbs = T.col(text), "|".join(VERBS)
    tied = F.lower(F.regexp_extract(t, rf"(?iuU)\b(?:{verbs})-t?-(il|elle|on)", 1))
    ahead = F.lower(F.regexp_extract(t, rf"(?iuU)\b(il|elle)\s+(?:{verbs})", 1))
    made = lambda p, c: F.struct(F.when(p == "il", "M").otherwise("F").alias("gender"), F.lit(c).alias("confidence"))
    return F.when(tied != "", made(tied, 0.8)).when(ahead != "", made(ahead, 0.75))


def attributed(quotes: DataFrame, partition: list[str], order: str, context: str = "context") -> DataFrame:
    """speaker, method, gender of each quote by the text around it, then by the turns of the conversation.

    A name decides; a pronoun takes the last name of its gender that was heard; what is left goes
    through the alternation of speakers.
    """
    found = quotes.withColumn("_named", explicit_speaker(context)).withColumn("_pronoun", pronoun_speaker(context))
    before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda g: F.last(F.when(F.col("_named.gender") == g, F.col("_named.name")), ignorenulls=True).over(before)
    found = found.withColumn("_heard", F.when(F.col("_pronoun.gender") == "M", last("M")).when(F.col("_pronoun.gender") == "F", last("F")))
    found = found.withColumn("explicit", F.coalesce("_named.name", "_heard"))
    out = casting.attributed(found, partition, order)
    method = F.when(F.col("_named").isNotNull(), "explicit").when(F.col("_heard").isNotNull(), "pronoun").otherwise(F.col("method"))
    return out.withColumn("method", method).withColumn("gender", F.coalesce("_named.gender", "_pronoun.gender", gender("speaker"))).drop("_named", "_pronoun", "_heard")


def valid_name(name: Column | str, ignored: tuple[str, ...] = NO_NAMES) -> Column:
    """A name has two letters or more, is no listed word and no number, and starts with a capital."""
    n = T.col(name)
    low = F.lower(T.strip(n))
    return F.coalesce(n.rlike(r"^\p{Lu}") & (F.length(low) >= 2) & ~low.isin(*ignored) & ~low.rlike(r"(?U)^\d+$"), F.lit(False))


def significant(cast: DataFrame, least: int = 2) -> DataFrame:
    """Characters that occur at least `least` times."""
    return cast.where(F.col("occurrences") >= least)


def first_dialogue(paragraphs: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """The first paragraph of each group that holds dialogue."""
    return paragraphs.where(T.is_dialogue(text)).groupBy(*keys).agg(F.min(order).alias(order), F.min_by(text, order).alias(text))


def emotional_score(text: Column | str, lang: str = "fr") -> Column:
    """Listed words in a paragraph, half a point for an exclamation mark and 0.3 for an ellipsis."""
    t = T.col(text)
    count = lambda mark: (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)
    words = sum((F.lower(t).contains(w).cast("int") for w in EMOTIONAL[lang]), F.lit(0))
    return words + count("!") * 0.5 + count("...") * 0.3


def most_emotional(paragraphs: DataFrame, keys: list[str], order: str, text: str = "text", lang: str = "fr") -> DataFrame:
    """The paragraph of each group with the highest score over zero, the first of equals."""
    scored = paragraphs.withColumn("score", emotional_score(text, lang)).where("score > 0")
    best = F.struct(F.col("score"), -F.col(order))
    return scored.groupBy(*keys).agg(F.max_by(order, best).alias(order), F.max_by(text, best).alias(text), F.max("score").alias("score"))
